"""Page assembly and rendering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from docpipe.functions import tables, tokens
from docpipe.functions.images import image_lines
from docpipe.operators import assemble, render
from docpipe.operators.extract import number_items as number_item_rows
from docpipe.operators.extract import number_pages as number_page_rows
from docpipe.plans.ordered import sliced_row_number
from docpipe.registry import query
from docpipe.registry.text import iso, strip, words

CONVERTED_AT = "2024-01-15T00:00:00+00:00"


@query("number_pages", """
SELECT doc_id, CAST(i AS INT) AS page_number, p[i] AS text
FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))""")
def number_pages(x):
    docs = x.table("documents").select("doc_id", F.split("text", "\n").alias("pages"))
    return number_page_rows(docs)


@query("assemble_text", """
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM fx_pages GROUP BY doc_id""")
def assemble_text(x):
    return assemble.assemble_text(x("fx_pages"))


@query("page_count", "SELECT doc_id, count(*) AS pages FROM fx_pages GROUP BY doc_id")
def page_count(x):
    return assemble.page_count(x("fx_pages"))


WARNINGS = """
SELECT doc_id, 'page' AS kind, page_number, 'bad stream' AS message, 'utf8' AS method, 'latin1' AS fallback
FROM fx_pages
UNION ALL
SELECT doc_id, 'fallback' AS kind, CAST(NULL AS INT) AS page_number, NULL AS message,
  'utf8' AS method, 'latin1' AS fallback FROM documents"""
WARNINGS_SQL = """
SELECT doc_id, concat('Primary extractor (utf8) failed, using fallback (latin1);',
  string_agg(concat('Page ', page_number, ' extraction failed: bad stream'), ';' ORDER BY page_number)) AS warnings
FROM fx_pages GROUP BY doc_id"""


@query("collect_warnings", WARNINGS_SQL)
def collect_warnings(x):
    found = assemble.collect_warnings(x.sql(WARNINGS))
    return found.select("doc_id", F.array_join("warnings", ";").alias("warnings"))


@query("doc_result", f"""
SELECT d.doc_id, p.pages, concat('whitespace=', p.n) AS tokens, d.extraction_method, coalesce(w.warnings, '') AS warnings
FROM fx_docs d LEFT JOIN (SELECT doc_id, count(*) AS pages, sum({words('text')}) AS n FROM fx_pages GROUP BY doc_id) p
  ON p.doc_id = d.doc_id LEFT JOIN ({WARNINGS_SQL}) w ON w.doc_id = d.doc_id""")
def doc_result(x):
    from docpipe.functions.scalars import map_as_text

    pages = x("fx_pages")
    counts = tokens.token_map(pages, WORDS).join(assemble.page_count(pages), "doc_id")
    result = assemble.doc_result(x("fx_docs"), counts, assemble.collect_warnings(x.sql(WARNINGS)))
    return result.withColumns(
        {"tokens": map_as_text(F.col("tokens")), "warnings": F.array_join("warnings", ";")}
    )


SHOWN = f"""
SELECT doc_id, page_number, {strip('text')} AS t FROM fx_pages WHERE {strip('text')} <> ''"""
TEXT_SQL = f"""
SELECT d.doc_id, coalesce(b.content, '') AS content FROM fx_docs d LEFT JOIN (
  SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page_number) AS content
  FROM ({SHOWN}) GROUP BY doc_id) b ON b.doc_id = d.doc_id"""
BODY_SQL = f"""
SELECT d.doc_id, coalesce(b.content, '') AS content FROM fx_docs d LEFT JOIN (
  SELECT doc_id, string_agg(concat(t, chr(10)), chr(10) ORDER BY page_number) AS content
  FROM ({SHOWN}) GROUP BY doc_id) b ON b.doc_id = d.doc_id"""


@query("render_text", TEXT_SQL)
def render_text(x):
    return render.render_text(x("fx_docs"), x("fx_pages"))


@query("render_markdown_plain", BODY_SQL)
def render_markdown_plain(x):
    return render.render_markdown(x("fx_docs"), x("fx_pages"), include_frontmatter=False)


# YAML of the frontmatter as text; the fixture's titles need quotes.
FRONT = f"""
SELECT d.doc_id, concat('source_file: ', source_file, chr(10),
  CASE WHEN source_hash = '' THEN '' ELSE concat('source_hash: ', source_hash, chr(10)) END,
  'converted_at: ''{CONVERTED_AT}''', chr(10), 'converter_version: 1.0.0', chr(10),
  CASE WHEN title IS NULL THEN '' ELSE concat('title: ''', title, '''', chr(10)) END,
  CASE WHEN author = '' THEN '' ELSE concat('author: ', author, chr(10)) END,
  'pages: ', page_count, chr(10),
  'tokens:', chr(10), '  whitespace: ', n, chr(10),
  'extraction_method: utf8', chr(10),
  'extraction_time_seconds: ', CAST(extraction_time_seconds AS VARCHAR),
  CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), 'warnings:', chr(10), '- Page 1 was blank') ELSE '' END) AS front
FROM fx_docs d LEFT JOIN (SELECT doc_id AS k, sum({words('text')}) AS n FROM fx_pages GROUP BY doc_id) c
  ON k = d.doc_id"""


WORDS = {"whitespace": "whitespace"}


def described(x):
    """fx_docs with pages, tokens and warnings; pages are gathered once."""
    notice = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Page 1 was blank"))).otherwise(
        F.array().cast("array<string>")
    )
    docs = x("fx_docs").withColumn("warnings", notice)
    return tokens.with_token_map(render.with_pages(docs, x("fx_pages")), WORDS)


@query("frontmatter", f"SELECT doc_id, front AS frontmatter FROM ({FRONT})")
def frontmatter(x):
    return render.frontmatter(described(x), converted_at=CONVERTED_AT)


@query("render_markdown", f"""
SELECT f.doc_id, concat('---', chr(10), front, chr(10), '---', chr(10), 
  CASE WHEN b.content = '' THEN '' ELSE concat(chr(10), b.content) END) AS content
FROM ({FRONT}) f JOIN ({BODY_SQL}) b ON b.doc_id = f.doc_id""")
def render_markdown(x):
    return render.render_markdown(described(x), converted_at=CONVERTED_AT)


JSON_SQL = f"""
SELECT d.doc_id, CAST(to_json({{'metadata': {{
  'source_file': source_file, 'source_hash': nullif(source_hash, ''), 'converted_at': '{CONVERTED_AT}',
  'converter_version': '1.0.0', 'pdf': {{'title': title, 'author': author, 'subject': NULL, 'creator': NULL,
    'producer': NULL, 'creation_date': {iso('creation_date')}, 'modification_date': NULL,
    'page_count': page_count, 'encrypted': encrypted, 'file_size_bytes': file_size_bytes}},
  'tokens': {{'whitespace': CAST(n AS BIGINT)}}, 'extraction_method': extraction_method,
  'extraction_time_seconds': extraction_time_seconds,
  'warnings': CASE WHEN doc_id % 2 = 0 THEN ['Page 1 was blank'] ELSE [] END}},
  'pages': ps}}) AS VARCHAR) AS content
FROM fx_docs d LEFT JOIN (SELECT doc_id AS k, sum({words('text')}) AS n,
  list({{'page_number': page_number, 'text': text, 'images': [], 'tables': [],
         'width': 0.0::DOUBLE, 'height': 0.0::DOUBLE}} ORDER BY page_number) AS ps
  FROM fx_pages GROUP BY doc_id) c ON k = d.doc_id"""


@query("render_json", JSON_SQL)
def render_json(x):
    return render.render_json(described(x), converted_at=CONVERTED_AT)


@query("render_yaml")
def render_yaml(x):
    return render.render_yaml(described(x), converted_at=CONVERTED_AT)


def parse_yaml(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import json

    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    for texts in batches:
        yield texts.map(
            lambda t: json.dumps(yaml.load(t, loader), ensure_ascii=False, separators=(",", ":"))
        )


@query("render_yaml_parsed", JSON_SQL)
def render_yaml_parsed(x):
    """The YAML read back: it must hold what the JSON holds."""
    parse = F.pandas_udf(parse_yaml, "string")
    text = render.render_yaml(described(x), converted_at=CONVERTED_AT)
    return text.withColumn("content", parse("content"))


@query("render_documents", f"""
SELECT d.doc_id, d.output_format,
  CASE d.output_format WHEN 'text' THEN t.content WHEN 'json' THEN j.content
       WHEN 'markdown' THEN m.content END AS content,
  CASE WHEN d.output_format = 'docx' THEN 'Unsupported format: docx' END AS error
FROM fx_docs d JOIN ({TEXT_SQL}) t ON t.doc_id = d.doc_id JOIN ({JSON_SQL}) j ON j.doc_id = d.doc_id
JOIN ({BODY_SQL}) m ON m.doc_id = d.doc_id""")
def render_documents(x):
    rendered = render.render_documents(
        described(x), converted_at=CONVERTED_AT, include_frontmatter=False
    )
    # YAML text has no SQL counterpart: `render_yaml` covers it.
    return rendered.withColumn("content", F.when(F.col("output_format") != "yaml", F.col("content")))


def grids(x):
    """One table per order: header row, then the cells; rows with index 5 are short."""
    cells = x("fx_cells")
    row = F.struct(
        "row_index", "part", "note",
        F.when(F.col("row_index") == 5, F.array("flag", "part"))
        .otherwise(F.array("flag", "part", "note")).alias("cells"),
    )
    header = F.array(F.array(F.lit("flag"), F.lit("part"), F.lit("note")))
    body = F.transform(F.array_sort(F.collect_list(row)), lambda r: r.cells)
    return cells.groupBy("doc_id", "page_number", "table_index").agg(F.concat(header, body).alias("grid"))


ROWS = """
SELECT doc_id, row_index, part, note, coalesce(flag, '') AS flag, row_index = 5 AS short FROM fx_cells"""


def grid_sql(row: str, head: str, tail: str, sep: str = "chr(10)") -> str:
    return (
        f"SELECT doc_id, concat({head}, string_agg({row}, {sep} ORDER BY row_index, part, note, flag), {tail}) AS content "
        f"FROM ({ROWS}) GROUP BY doc_id"
    )


MARKDOWN_TABLE = grid_sql(
    "concat('| ', flag, ' | ', part, ' | ', CASE WHEN short THEN '' ELSE note END, ' |')",
    "'| flag | part | note |', chr(10), '| --- | --- | --- |', chr(10)", "''",
)
TD = "concat('      <td>', {c}, '</td>', chr(10))"
HTML_TABLE = grid_sql(
    f"concat('    <tr>', chr(10), {TD.format(c='flag')}, {TD.format(c='part')}, "
    f"CASE WHEN short THEN '' ELSE {TD.format(c='note')} END, '    </tr>')",
    "'<table>', chr(10), '  <thead>', chr(10), '    <tr>', chr(10), '      <th>flag</th>', chr(10), "
    "'      <th>part</th>', chr(10), '      <th>note</th>', chr(10), '    </tr>', chr(10), '  </thead>', chr(10), "
    "'  <tbody>', chr(10)",
    "chr(10), '  </tbody>', chr(10), '</table>'",
)
CODE_TABLE = grid_sql(
    "concat(flag, chr(9), part, CASE WHEN short THEN '' ELSE concat(chr(9), note) END)",
    "'```', chr(10), 'flag', chr(9), 'part', chr(9), 'note', chr(10)", "chr(10), '```'",
)
# Every note holds a comma or a quote, so every note is quoted.
CSV_TABLE = grid_sql(
    "concat(flag, ',', part, CASE WHEN short THEN '' ELSE concat(',\"', replace(note, '\"', '\"\"'), '\"') END)",
    "'flag,part,note', chr(13), chr(10)", "''", "chr(13) || chr(10)",
)


def _table_query(name, sql):
    @query(f"table_{name}", sql)
    def run(x):
        return grids(x).select("doc_id", tables.render_table(F.col("grid"), name).alias("content"))


for _name, _sql in (
    ("markdown", MARKDOWN_TABLE), ("html", HTML_TABLE), ("code", CODE_TABLE), ("csv", CSV_TABLE),
):
    _table_query(_name, _sql)


@query("render_tables", f"""
SELECT doc_id, 1 AS page_number, concat(content, chr(10), chr(10), content, chr(10)) AS content
FROM ({MARKDOWN_TABLE})""")
def render_tables(x):
    table = F.struct(F.col("grid").alias("data"))
    empty = F.struct(F.array().cast("array<array<string>>").alias("data"))
    pages = grids(x).select("doc_id", "page_number", F.array(table, empty, table).alias("tables"))
    return render.render_tables(pages)


def page_images(x):
    image = F.struct("seq", "width", "height")
    return x("fx_images").groupBy("doc_id", "page_number").agg(
        F.array_sort(F.collect_list(image)).alias("images")
    )


NUMBERED = """
SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY seq, width, height) AS i FROM fx_images"""


@query("image_refs", f"""
SELECT doc_id, page_number,
  string_agg(concat('![Image ', i, ' on page ', page_number, ']()'), chr(10) ORDER BY i) AS reference,
  string_agg(concat('![Image ', i, '](page', page_number, '_image', i, '.png)'), chr(10) ORDER BY i) AS extract,
  '' AS skip
FROM ({NUMBERED}) GROUP BY doc_id, page_number""")
def image_refs(x):
    images, page = F.col("images"), F.col("page_number")
    return page_images(x).select(
        "doc_id", "page_number",
        image_lines(images, page, "reference").alias("reference"),
        image_lines(images, page, "extract", output_dir="images").alias("extract"),
        image_lines(images, page, "skip").alias("skip"),
    )


@query("image_boxes", f"""
SELECT doc_id, page_number, string_agg(concat('[Image ', i, ': ', CAST(round_even(width, 0) AS BIGINT), 'x',
  CAST(round_even(height, 0) AS BIGINT), 'px on page ', page_number, ']'), chr(10) ORDER BY i) AS content
FROM ({NUMBERED}) GROUP BY doc_id, page_number""")
def image_boxes(x):
    return render.image_boxes(page_images(x))


@query("number_items", f"""
SELECT doc_id, page_number, CAST(i AS INT) AS item_index, seq, width, height FROM ({NUMBERED})""")
def number_items(x):
    return number_item_rows(page_images(x), "images").select(
        "doc_id", "page_number", "item_index", "item.*"
    )


@query("number_items_long", f"SELECT doc_id, page_number, seq, width, height, i AS item_index FROM ({NUMBERED})")
def number_items_long(x):
    slices = (F.col("seq") / 4).cast("int")
    order = [F.col("seq"), F.col("width"), F.col("height")]
    return sliced_row_number(x("fx_images"), ["doc_id", "page_number"], order, slices, "item_index")
