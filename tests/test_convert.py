"""Validation, extraction, token counting and the whole conversion."""

import hashlib
import re
import sys
import time
from datetime import datetime, timezone

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docpipe.functions import tokens
from docpipe.functions.udfs import register_udfs
from docpipe.operators.extract import Page, extract_pages, extract_with_fallback, probe, read_metadata
from docpipe.operators.validate import check_upload, content_hash, validate_files
from docpipe.plans.convert import conversion_ledger, conversion_results, convert_corpus
from docpipe.sources.blobs import scan_files

# The back ends below are not installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILES = "path string, size bigint, content binary, exists boolean, is_file boolean"


def files(spark, *contents):
    rows = [(f"in/{i}.pdf", len(c), bytearray(c), True, True) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, FILES)


def test_validation_order(spark):
    big = b"%PDF-1.4" + b"x" * (5 * 1024 * 1024)
    rows = [
        ("missing.pdf", None, None, False, True), ("dir", 0, None, True, False),
        ("empty.pdf", 0, bytearray(b""), True, True), ("big.pdf", len(big), bytearray(big), True, True),
        ("text.pdf", 14, bytearray(b"Not a PDF file"), True, True),
        ("ok.pdf", 14, bytearray(b"%PDF-1.4\n%%EOF"), True, True),
        ("limit.pdf", 1024 * 1024, bytearray(b"%PDF-"), True, True),
        ("round.pdf", int(1.25 * 1024 * 1024), bytearray(b"%PDF-"), True, True),
    ]
    got = {r.path: r.error for r in validate_files(spark.createDataFrame(rows, FILES), 1).collect()}
    assert got == {
        "missing.pdf": "File does not exist: missing.pdf", "dir": "Path is not a file: dir",
        "empty.pdf": "File is empty", "big.pdf": "File too large: 5.0 MB (max: 1 MB)",
        "text.pdf": "File is not a valid PDF (invalid signature)", "ok.pdf": "", "limit.pdf": "",
        "round.pdf": "File too large: 1.2 MB (max: 1 MB)",
    }


def test_hashes(spark):
    data = b"Hello, World!"
    for algorithm in ("sha256", "md5", "sha1"):
        row = content_hash(files(spark, data), algorithm).collect()[0]
        assert row.content_hash == hashlib.new(algorithm, data).hexdigest()
        assert row.source_hash == f"{algorithm}:{row.content_hash}"
    with pytest.raises(ValueError, match="Unsupported hash algorithm: crc"):
        content_hash(files(spark, data), "crc")


def test_upload_rules(spark):
    rows = [(None, "text", "pymupdf"), ("a.PDF", "text", "pymupdf"), ("a.pdf", "doc", "pymupdf"),
            ("a.pdf", "text", "auto"), ("a.pdf", "text", "pdfplumber")]
    df = spark.createDataFrame(rows, "filename string, output_format string, extractor string")
    codes = [(r.status_code, r.detail.split(".")[0]) for r in check_upload(df).collect()]
    assert codes == [
        (400, "File name is required"), (400, "Only PDF files are supported"), (400, "Invalid output format"),
        (400, "Invalid extractor"), (200, ""),
    ]


class Shaky:
    """Fails on documents with '!', hangs on '?', reports one bad page on '#'."""

    name = "shaky"

    def extract(self, content):
        text = content.decode("utf-8")
        if "!" in text:
            raise ValueError("bad stream")
        if "?" in text:
            time.sleep(30)
        pages = [Page(t, tables=[{"data": []}, {"data": [["a", None]]}]) for t in text.split("\f")]
        if "#" in text:
            pages[1] = Page(width=5.0, error="torn page")
        return {"title": "T"}, pages


def test_user_backend(spark):
    df = files(spark, b"one\ftwo", b"x\f#\fz", b"bad!", b"slow?", b"\xff")
    rows = extract_pages(df, Shaky(), timeout_seconds=0.5).orderBy("path").collect()
    assert [p.text for p in rows[0].pages] == ["one", "two"]
    assert [p.page_number for p in rows[0].pages] == [1, 2]
    assert rows[0].pages[0].tables[0].data == [["a", None]] and len(rows[0].pages[0].tables) == 1
    assert (rows[0].metadata.title, rows[0].metadata.page_count, rows[0].method) == ("T", 2, "shaky")
    assert [p.text for p in rows[1].pages] == ["x", "", "z"]
    assert rows[1].warnings == ["Page 2 extraction failed: torn page"]
    assert rows[2].error == "PDF extraction failed: bad stream" and rows[2].pages is None
    assert "more than 0.5 s" in rows[3].error
    assert "can't decode" in rows[4].error


def test_fallback_chains(spark):
    df = files(spark, b"fine", b"bad!", b"\xe9!")
    rows = extract_with_fallback(df, [Shaky(), "latin1"]).orderBy("path").collect()
    assert [r.method for r in rows] == ["shaky", "latin1", "latin1"]
    assert rows[1].warnings == ["Primary extractor (shaky) failed, using fallback (latin1)"]
    assert rows[2].pages[0].text == "é!"
    rows = extract_with_fallback(df, [Shaky(), "utf8"]).orderBy("path").collect()
    assert rows[2].error.startswith("Both extractors failed: primary=shaky, fallback=utf8. Error: ")
    native = extract_with_fallback(df, ["utf8", "latin1"]).orderBy("path").collect()
    assert [r.method for r in native] == ["utf8", "utf8", "latin1"]
    assert native[2].warnings == ["Primary extractor (utf8) failed, using fallback (latin1)"]
    strict = extract_pages(df, "utf8").orderBy("path").collect()
    assert strict[2].error == "PDF extraction failed: content is not utf8 text" and strict[2].pages is None
    with pytest.raises(ValueError, match="Unknown extractor method"):
        extract_pages(df, "ocr")


def test_native_and_python_pages_agree(spark):
    text = b"\n".join(b"line %d" % i for i in range(23))
    df = files(spark, text, b"", b"a\n", b"\f")
    native = extract_with_fallback(df, ["utf8"], lines_per_page=5).orderBy("path").collect()

    class Other:
        name = "never"

        def extract(self, content):
            raise ValueError

    python = extract_with_fallback(df, [Other(), "utf8"], lines_per_page=5).orderBy("path").collect()
    assert [[p.text for p in r.pages] for r in native] == [[p.text for p in r.pages] for r in python]
    assert len(native[0].pages) == 5


def test_conversion_outcomes(spark):
    df = files(spark, b"%PDF-1.4\fpage two", b"", b"plain", b"%PDF- caf\xe9")
    done = convert_corpus(df, "text", counters={"words": "whitespace"}).orderBy("path")
    rows = done.collect()
    assert [r.status for r in rows] == ["COMPLETED", "FAILED", "FAILED", "COMPLETED"]
    assert rows[0].content == "%PDF-1.4\n\npage two" and rows[0].page_count == 2 and rows[0].tokens == {"words": 3}
    assert rows[1].error_message == "PDF validation failed: File is empty" and rows[1].content is None
    assert rows[3].extraction_method == "latin1" and rows[3].content == "%PDF- café"
    assert conversion_results(done, "path").count() == 2
    assert conversion_ledger(done).count() == 4
    with pytest.raises(ValueError, match="Unsupported format: docx"):
        convert_corpus(df, "docx")


class Facts:
    """Knows a document's facts without its pages, which it must not be asked for."""

    name = "facts"

    def metadata(self, content):
        if content.startswith(b"bad"):
            raise ValueError("no facts")
        return {"title": content[:4].decode("latin1"), "page_count": 7, "encrypted": content.endswith(b"!")}

    def can_read(self, content):
        return not content.startswith(b"bad")

    def extract(self, content):
        raise AssertionError("pages were asked for")


def test_metadata_without_pages(spark):
    df = files(spark, b"fine!", b"bad one", b"bad\xe9")
    rows = read_metadata(df, [Facts(), "utf8"]).orderBy("path").collect()
    assert [r.method for r in rows] == ["facts", "utf8", None]
    assert (rows[0].metadata.title, rows[0].metadata.page_count, rows[0].metadata.encrypted) == ("fine", 7, True)
    assert rows[1].metadata.page_count == 1 and rows[1].error is None
    assert rows[2].error.startswith("Both extractors failed to get metadata: Failed to extract metadata: ") and rows[2].metadata is None
    # A back end without the two methods is asked for its pages.
    rows = read_metadata(df, [Shaky()]).orderBy("path").collect()
    assert rows[1].metadata.page_count == 1 and rows[0].error.startswith("Failed to extract metadata")
    for lines in (None, 2):
        same = files(spark, b"a\nb\nc\nd", b"a\fb\n", b"", b"\n")
        native = read_metadata(same, ["utf8", "latin1"], lines).orderBy("path").collect()
        pages = extract_with_fallback(same, ["utf8", "latin1"], lines).orderBy("path").collect()
        python = read_metadata(same, [Missing(), "utf8", "latin1"], lines).orderBy("path").collect()
        counts = [r.metadata.page_count for r in native]
        assert counts == [r.metadata.page_count for r in pages] == [r.metadata.page_count for r in python]


class Missing:
    name = "missing"

    def extract(self, content):
        raise ValueError("never")


def test_probe(spark):
    df = files(spark, b"fine", b"bad one", b"bad\xe9", b"none")
    df = df.withColumn("content", F.when(F.col("content") != F.lit(b"none"), F.col("content")))
    rows = probe(df, [Facts(), "utf8", Missing()]).orderBy("path").collect()
    assert [r.readable["facts"] for r in rows] == [True, False, False, False]
    assert [r.readable["utf8"] for r in rows] == [True, True, False, False]
    assert not any(r.readable["missing"] for r in rows)


def test_times_and_output_batches(spark):
    class Slow:
        name = "slow"

        def extract(self, content):
            time.sleep(0.002 * (content[-1] - 48))
            return {}, [Page("x")]

    df = files(spark, *[b"doc %d" % (i % 10) for i in range(200)]).coalesce(1)
    rows = extract_with_fallback(df, [Slow()]).collect()
    assert len({r.seconds for r in rows}) > 100 and max(r.seconds for r in rows) > 0.015

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    batches = [r.n for r in extract_with_fallback(df, [Missing(), "utf8"]).select("path").mapInArrow(sizes, "n long").collect()]
    assert sum(batches) == 200 and len(batches) <= 3
    done = convert_corpus(files(spark, b"%PDF-a"), "markdown", extractors=[Missing(), "utf8"]).collect()[0]
    stamp = re.search(r"converted_at: '([^']+)'", done.content)[1]
    assert abs((datetime.fromisoformat(stamp) - datetime.now(timezone.utc)).total_seconds()) < 600


def test_format_per_file(spark):
    df = files(spark, b"%PDF-a", b"%PDF-b", b"%PDF-c", b"%PDF-d").withColumn(
        "output_format", F.element_at(F.array(*map(F.lit, ["text", "json", "yaml", "odt"])),
                                      F.substring("path", 4, 1).cast("int") + 1)
    )
    rows = convert_corpus(df, F.col("output_format"), converted_at="now").orderBy("path").collect()
    assert rows[0].content == "%PDF-a"
    assert rows[1].content.startswith('{"metadata":{"source_file":"1.pdf"')
    assert rows[2].content.startswith("metadata:\n  source_file: 2.pdf")
    assert (rows[3].status, rows[3].error_message) == ("FAILED", "Unsupported format: odt")


def test_ledger_does_not_render(spark):
    done = convert_corpus(files(spark, b"%PDF-a"), "yaml", counters={"n": len})
    plan = done.select("path", "status", "error_message")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_binary_files_and_manifest(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-a")
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "b.txt").write_bytes(b"x")
    found = scan_files(spark, str(tmp_path), glob="*.pdf")
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["a.pdf"]
    names = [(f"file:{tmp_path}/{n}", s) for n, s in (("a.pdf", 6), ("empty.pdf", 0))]
    manifest = spark.createDataFrame(names, "path string, size bigint")
    rows = validate_files(scan_files(spark, str(tmp_path), "*.pdf", manifest=manifest)).orderBy("path").collect()
    assert [r.error for r in rows] == ["", "File is empty"]


TEXTS = ["Hello world this is a test", "", "  a　b\xa0c\n", "one"]


def test_counters(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    counters = {
        "words": "whitespace", "custom": lambda t: len(t.split()), "string": lambda t: "x", "negative": lambda t: -1,
        "raises": lambda t: 1 // 0,
    }
    rows = tokens.count_tokens(df, counters).orderBy("i").collect()
    assert [r.words for r in rows] == [r.custom for r in rows] == [6, 0, 3, 1]
    assert all(r.string is None and r.negative is None and r.raises is None for r in rows)
    with pytest.raises(ValueError, match="must be callable"):
        tokens.count_tokens(df, {"bad": 5})
    with pytest.raises(ValueError, match="Unknown token counter"):
        tokens.count_tokens(df, "sentencepiece")


def test_bpe_from_rank_file(spark, tmp_path):
    import base64

    ranks = [bytes([b]) for b in range(256)] + [b"He", b"ll"]
    path = tmp_path / "tiny.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(ranks)))
    counter = tokens.BpeCounter("tiny", str(path), r"\S+|\s+", {"<|endoftext|>": 999})
    df = spark.createDataFrame([("Hello",), ("",), ("a<|endoftext|>",), ("He ll",)], "text string")
    rows = tokens.count_tokens(df, {"n": counter}).collect()
    assert [r.n for r in rows] == [3, 0, None, 3]
    spark.sparkContext.addFile(str(path))
    shipped = tokens.BpeCounter("tiny", "tiny.tiktoken", r"\S+|\s+")
    assert [r.n for r in tokens.count_tokens(df, {"n": shipped}).collect()][0] == 3


def test_estimate(spark):
    rows = spark.range(0, 3000).select("id", tokens.estimate_tokens(F.col("id")).alias("e")).collect()
    assert all(r.e == int(r.id * 1.1) for r in rows)


def test_sql_names(spark):
    names = register_udfs(spark, {"letters": len})
    assert "letters" in names
    row = spark.sql(
        "SELECT strip_text(' a　') s, parse_pdf_date('D:20240229000000Z') d, estimate_tokens(19) e, "
        "count_tokens_whitespace('a b') n, letters('abc') l, "
        "table_csv(array(array('a', 'b,c'), array('', CAST(NULL AS STRING)))) c, table_code(array(array('a'))) k, "
        "table_html(array(array('a'), array('b'))) h, table_markdown(array(array('a', 'b'), array('1'))) m"
    ).collect()[0]
    assert (row.s, str(row.d), row.e, row.n, row.l) == ("a", "2024-02-29 00:00:00", 20, 2, 3)
    assert row.c == 'a,"b,c"\r\n,' and row.k == "```\na\n```"
    assert row.h.count("<td>b</td>") == 1 and row.m == "| a | b |\n| --- | --- |\n| 1 |  |"
