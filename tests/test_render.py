"""Rendering against reference values and Python's own csv and yaml."""

import csv
import io
import json
from datetime import datetime

import pytest
import yaml
from pyspark.sql import functions as F

from docpipe.functions import scalars, tables
from docpipe.functions.images import image_lines
from docpipe.functions.yaml_text import yaml_dumper
from docpipe.operators import render

AT = "2024-01-15T10:00:00+00:00"


@pytest.fixture
def sample(spark):
    docs = spark.createDataFrame(
        [(1, "test.pdf", "sha256:abc123", "Test PDF", "Test Author", 2, False, 1024, "pdfplumber", 1.5)],
        "doc_id int, source_file string, source_hash string, title string, author string, page_count int, "
        "encrypted boolean, file_size_bytes bigint, extraction_method string, extraction_time_seconds double",
    )
    pages = spark.createDataFrame(
        [(1, 2, "Test Page 2", 612.0, 792.0), (1, 1, "Test Page 1", 612.0, 792.0)],
        "doc_id int, page_number int, text string, width double, height double",
    )
    return docs, pages


def content(df):
    return df.collect()[0].content


def test_text(sample):
    assert content(render.render_text(*sample)) == "Test Page 1\n\nTest Page 2"
    assert content(render.render_text(*sample, page_separator="|")) == "Test Page 1|Test Page 2"


def test_markdown(sample):
    assert content(render.render_markdown(*sample, include_frontmatter=False)) == "Test Page 1\n\nTest Page 2\n"
    text = content(render.render_markdown(*sample, converted_at=AT))
    _, front, body = text.split("---\n", 2)
    assert body == "\nTest Page 1\n\nTest Page 2\n"
    want = {
        "source_file": "test.pdf", "source_hash": "sha256:abc123", "converted_at": AT,
        "converter_version": "1.0.0", "title": "Test PDF", "author": "Test Author", "pages": 2,
        "extraction_method": "pdfplumber", "extraction_time_seconds": 1.5,
    }
    assert front == yaml.dump(want, default_flow_style=False, sort_keys=False, allow_unicode=True)


def test_frontmatter_tokens_flag(sample):
    docs = sample[0].withColumn("tokens", F.create_map(F.lit("n"), F.lit(5).cast("bigint")))
    assert "tokens" in render.frontmatter(docs).collect()[0].frontmatter
    assert "tokens" not in render.frontmatter(docs, include_tokens=False).collect()[0].frontmatter


def test_json_and_yaml_agree(sample):
    document = json.loads(content(render.render_json(*sample, converted_at=AT)))
    assert list(document) == ["metadata", "pages"]
    assert document["metadata"]["pdf"]["page_count"] == 2
    assert document["metadata"]["pdf"]["subject"] is None
    assert document["metadata"]["tokens"] is None
    assert document["metadata"]["warnings"] == []
    assert document["pages"][0] == {
        "page_number": 1, "text": "Test Page 1", "images": [], "tables": [], "width": 612.0, "height": 792.0,
    }
    text = content(render.render_yaml(*sample, converted_at=AT))
    assert text == yaml.dump(document, default_flow_style=False, sort_keys=False, allow_unicode=True)


def test_page_edges(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    rows = [(1, n, f"p{n}" if n != 5 else " \n") for n in range(12, 0, -1)] + [(2, 1, "\t"), (2, 2, None)]
    pages = spark.createDataFrame(rows, "doc_id int, page_number int, text string")
    texts = {r.doc_id: r.content for r in render.render_text(docs, pages).collect()}
    assert texts == {1: "\n\n".join(f"p{n}" for n in range(1, 13) if n != 5), 2: "", 3: ""}
    plain = {r.doc_id: r.content for r in render.render_markdown(docs, pages, include_frontmatter=False).collect()}
    assert plain[2] == plain[3] == ""
    front = {r.doc_id: r.content for r in render.render_markdown(docs, pages, converted_at=AT).collect()}
    assert front[3].startswith("---\n") and front[3].endswith("\n---\n")


def test_formats_per_row(sample, spark):
    docs, pages = sample
    both = docs.withColumn("output_format", F.lit("text")).unionByName(
        docs.withColumn("doc_id", F.lit(2)).withColumn("output_format", F.lit("docx"))
    )
    got = {r.doc_id: (r.content, r.error) for r in render.render_documents(both, pages).collect()}
    assert got[1] == ("Test Page 1\n\nTest Page 2", None)
    assert got[2] == (None, "Unsupported format: docx")


GRIDS = [
    None, [], [[]], [["h"]], [[None]], [[""]], [["a", "b"], ["1"], ["1", "2", "3"], [None, "x"]],
    [['q"uote', "comma,", "line\nbreak", "cr\r", " lead"], ["", "", "", "", ""]], [["a"], [""], ["b"]],
    [["x | y", "<b>"], ["tab\t", "end  "]], [["a", "b"], []],
]


@pytest.fixture
def grid_table(spark):
    rows = [(i, g) for i, g in enumerate(GRIDS)]
    return spark.createDataFrame(rows, "i int, grid array<array<string>>")


def column(df, fmt):
    return {r.i: r.x for r in df.select("i", tables.render_table(F.col("grid"), fmt).alias("x")).collect()}


def test_csv_equals_python(grid_table):
    got = column(grid_table, "csv")
    for i, grid in enumerate(GRIDS):
        out = io.StringIO()
        csv.writer(out).writerows([[c or "" for c in row] for row in grid or []])
        assert got[i] == out.getvalue().rstrip(), grid


def test_markdown_table(grid_table):
    got = column(grid_table, "markdown")
    assert [got[i] for i in range(6)] == ["", "", "", "| h |\n| --- |", "|  |\n| --- |", "|  |\n| --- |"]
    assert got[6] == "| a | b |\n| --- | --- |\n| 1 |  |\n| 1 | 2 |\n|  | x |"


def test_html_and_code_tables(grid_table):
    html, code = column(grid_table, "html"), column(grid_table, "code")
    assert html[0] == html[1] == code[0] == code[1] == ""
    assert html[3].split("\n") == [
        "<table>", "  <thead>", "    <tr>", "      <th>h</th>", "    </tr>", "  </thead>", "</table>",
    ]
    assert html[8].count("<td>") == 2 and "  <tbody>" in html[8]
    assert "<th><b></th>" in html[9]
    assert code[6] == "```\na\tb\n1\n1\t2\t3\n\tx\n```"


def test_unknown_formats():
    with pytest.raises(ValueError):
        tables.render_table(F.lit(None), "latex")
    with pytest.raises(ValueError, match="output_dir"):
        image_lines(F.lit(None), F.lit(1), "extract")


def test_page_tables(spark):
    pages = spark.createDataFrame(
        [(1, 1, [([["a"], ["b"]],), ([],), ([["c"]],)]), (1, 2, []), (1, 3, None)],
        "doc_id int, page_number int, tables array<struct<data:array<array<string>>>>",
    )
    got = {r.page_number: r.content for r in render.render_tables(pages).collect()}
    assert got == {1: "| a |\n| --- |\n| b |\n\n| c |\n| --- |\n", 2: "", 3: ""}


def test_image_boxes_round_half_even(spark):
    pages = spark.createDataFrame(
        [(1, 3, [(0.5, 2.5), (1.5, 100.4), (None, 3.0)]), (1, 4, [])],
        "doc_id int, page_number int, images array<struct<width:double,height:double>>",
    )
    got = {r.page_number: r.content for r in render.image_boxes(pages).collect()}
    assert got[3] == "\n".join([
        "[Image 1: 0x2px on page 3]", "[Image 2: 2x100px on page 3]", "[Image 3: 0x3px on page 3]",
    ])
    assert got[4] == ""


def test_strip_equals_python(spark):
    texts = ["", " a ", "\x1c\x85\xa0a b　\n", "​ a", " x ", "\n\t \r", "é  "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.s for r in df.select("i", scalars.strip_text(F.col("t")).alias("s")).collect()}
    assert got == {i: t.strip() for i, t in enumerate(texts)}


def test_dates(spark):
    raw = ["D:20231225120000Z", "D:20231225120000+02'00", "20240229235959", "D:20231225", "D:20231399120000",
           "D:20230229000000", "D:2023122512000x", "D:20231225240000", "D:00001225120000", "", None]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    got = [r.d for r in df.select("i", scalars.parse_pdf_date(F.col("raw")).alias("d")).orderBy("i").collect()]
    assert got == [datetime(2023, 12, 25, 12)] * 2 + [datetime(2024, 2, 29, 23, 59, 59)] + [None] * 8
    times = [datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 120), datetime(2024, 1, 1, 1, 2, 3, 500000), None]
    df = spark.createDataFrame(list(enumerate(times)), "i int, t timestamp_ntz")
    got = [r.d for r in df.select("i", scalars.iso_format(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == [t and t.isoformat() for t in times]


def test_sidecar(spark):
    texts = ["a=1\nb=2\na=3", "  x=y=z\nnoequals\n=v \n", "", "aa=1\na=2"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    parsed = df.withColumn("m", scalars.parse_sidecar(F.col("t")))
    got = {r.i: r.m for r in parsed.collect()}
    assert got == {0: {"a": "3", "b": "2"}, 1: {"x": "y=z", "": "v"}, 2: {}, 3: {"aa": "1", "a": "2"}}
    lines = parsed.withColumn("l", scalars.render_sidecar(F.col("m"))).orderBy("i").collect()
    assert [r.l for r in lines] == ["a=3\nb=2", "x=y=z\n=v", "", "aa=1\na=2"]


@pytest.mark.parametrize("text", [
    "plain", "multi\nline", "trailing \nspace", "a\n b", "x" * 200, "word " * 60, "é ü 中", "tab\there", " ",
    "yes", "1.0", "2024-01-01", "- item", "# no", "it's \"so\"", "back\\n", "", " lead", "emoji \U0001f600", "a: b",
])
def test_fast_yaml_is_the_same(text):
    value = {"a": text, "b": [text, {"c": text}], "n": None, "t": True, "f": 0.5}
    want = yaml.dump(value, default_flow_style=False, sort_keys=False, allow_unicode=True)
    assert yaml_dumper()(json.dumps(value, ensure_ascii=False)) == want
