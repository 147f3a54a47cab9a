"""Page extraction from file bytes.

The bundled back ends ``utf8`` (strict) and ``latin1`` are native expressions:
a document becomes an array of pages inside its own row, without a shuffle.
Other back ends are Python objects and run over small Arrow batches.
"""

from __future__ import annotations

import signal
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docpipe.schemas import EMPTY_IMAGES, EMPTY_TABLES, PAGE_FIELDS, PDF_FIELDS

BUNDLED = ("utf8", "latin1")
PDF_STRUCT = "struct<" + ",".join(f"{name}:{dtype}" for name, dtype in PDF_FIELDS) + ">"
EXTRACTION = f"method string, error string, metadata {PDF_STRUCT}, pages array<{PAGE_FIELDS}>, warnings array<string>, seconds double"
METADATA = f"method string, error string, metadata {PDF_STRUCT}"
#: Bytes of content and text that a batch of extracted rows holds, but for one
#: larger document.
OUTPUT_BYTES = 4 << 20


@dataclass
class Page:
    """A page from a user back end; ``error`` marks one that failed."""

    text: str = ""
    images: list[dict[str, float]] = field(default_factory=list)
    tables: list[dict[str, list[list[str | None]]]] = field(default_factory=list)
    width: float = 0.0
    height: float = 0.0
    error: str | None = None


class Backend(Protocol):
    """User back end: raises if the document cannot be read.

    Two more methods are optional. ``metadata(content)`` returns the facts of a
    document without its pages; without it they come from ``extract``.
    ``can_read(content)`` tells whether it can be read; without it, it can if
    its metadata can."""

    name: str

    def extract(self, content: bytes) -> tuple[dict[str, Any], list[Page]]: ...


def can_read(backend: str, content: Column) -> Column:
    """Whether a bundled back end can decode the bytes."""
    if backend == "utf8":
        return F.coalesce(F.is_valid_utf8(content.cast("string")), F.lit(False))
    if backend == "latin1":
        return content.isNotNull()
    raise ValueError(f"Unknown extractor method: {backend}")


def decoded(backend: str, content: Column) -> Column:
    return content.cast("string") if backend == "utf8" else F.decode(content, "ISO-8859-1")


def split_pages(df: DataFrame, text_col: str, out: str, lines_per_page: int | None = None) -> DataFrame:
    """Adds the array of page texts: cut at form feeds, or every
    ``lines_per_page`` lines. The lines are a column of their own, so that the
    text is split once and not again for each page."""
    if lines_per_page is None:
        return df.withColumn(out, F.split(text_col, "\f"))
    step, lines = F.lit(lines_per_page), F.col("__lines")
    last = F.floor((F.size(lines) - 1) / step).cast("int")
    pages = F.transform(
        F.sequence(F.lit(0), last),
        lambda p: F.array_join(F.slice(lines, p * step + F.lit(1), step), "\n"),
    )
    return df.withColumn("__lines", F.split(text_col, "\n")).withColumn(out, pages).drop("__lines")


def page_structs(texts: Column) -> Column:
    """Numbered page structs (1-based) around an array of page texts."""
    return F.transform(
        texts,
        lambda text, i: F.struct(
            (i + 1).cast("int").alias("page_number"),
            text.alias("text"),
            F.array().cast(EMPTY_IMAGES).alias("images"),
            F.array().cast(EMPTY_TABLES).alias("tables"),
            F.lit(0.0).alias("width"),
            F.lit(0.0).alias("height"),
        ),
    )


def _numbered(df: DataFrame, array_col: str, number: str, out: str) -> DataFrame:
    """One row per array element with its 1-based position.

    Outer, then filtered on the position: for a plain explode Spark infers a
    filter on the array and computes the whole array a second time for it.
    """
    others = [c for c in df.columns if c != array_col]
    rows = df.select(*others, F.posexplode_outer(array_col).alias("__pos", out))
    return rows.filter(F.col("__pos").isNotNull()).select(
        *others, (F.col("__pos") + 1).cast("int").alias(number), out
    )


def number_pages(docs: DataFrame, pages_col: str = "pages") -> DataFrame:
    """One row per page text with its 1-based ``page_number``."""
    return _numbered(docs, pages_col, "page_number", "text")


def number_items(pages: DataFrame, items_col: str, out: str = "item") -> DataFrame:
    """One row per image or table of a page with its 1-based ``item_index``."""
    return _numbered(pages, items_col, "item_index", out)


def page_rows(extracted: DataFrame, *keys: str) -> DataFrame:
    """``keys, page_number, text, images, tables, width, height`` per page of
    extracted documents."""
    return _numbered(extracted.select(*keys, "pages"), "pages", "__number", "__page").select(
        *keys, "__page.*"
    )


def fallback_warning(primary: str, secondary: str) -> str:
    return f"Primary extractor ({primary}) failed, using fallback ({secondary})"


def extract_with_fallback(
    files: DataFrame, chain: Sequence[str | Backend] = ("utf8", "latin1"),
    lines_per_page: int | None = None, timeout_seconds: float | None = None,
) -> DataFrame:
    """Adds ``method, error, metadata, pages, warnings, seconds`` to each file
    row.

    The back ends of the chain are tried in order. A document none can read
    keeps its row with ``error`` set and ``pages`` null. ``seconds`` is the
    time a Python back end took for the document; the bundled ones are part of
    Spark's own plan, where a document has no time of its own, and give 0.
    """
    if not chain:
        raise ValueError("At least one extractor is needed")
    if all(isinstance(backend, str) for backend in chain):
        return _extract_native(files, list(chain), lines_per_page)
    return _extract_python(files, list(chain), lines_per_page, timeout_seconds)


def extract_pages(files: DataFrame, backend: str | Backend = "utf8",
                  lines_per_page: int | None = None, timeout_seconds: float | None = None) -> DataFrame:
    """`extract_with_fallback` with a single back end."""
    return extract_with_fallback(files, [backend], lines_per_page, timeout_seconds)


def _chain_error(names: Sequence[str], errors: Sequence[str]) -> str:
    if len(names) == 1:
        return errors[0]
    return f"Both extractors failed: primary={names[0]}, fallback={names[-1]}. Error: {errors[-1]}"


def _extract_native(files: DataFrame, chain: list[str], lines_per_page: int | None) -> DataFrame:
    content, used = F.col("content"), F.col("method")
    method, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(chain):
        method = F.when(can_read(name, content), F.lit(name)).otherwise(method)
        text = F.when(used == name, decoded(name, content)).otherwise(text)
    no_warning = F.array().cast("array<string>")
    warnings = no_warning
    for name in chain[1:]:
        notice = F.array(F.lit(fallback_warning(chain[0], name)))
        warnings = F.when(used == name, notice).otherwise(warnings)
    failure = _chain_error(chain, [f"PDF extraction failed: content is not {name} text" for name in chain])
    given = {
        "page_count": F.size("pages"),
        "encrypted": F.lit(False),
        "file_size_bytes": F.col("size").cast("bigint"),
    }
    metadata = F.struct(
        *[given.get(name, F.lit(None).cast(dtype)).cast(dtype).alias(name) for name, dtype in PDF_FIELDS]
    )
    texts = files.withColumn("method", method).withColumn("__text", text)
    return (
        split_pages(texts, "__text", "__pages", lines_per_page)
        .withColumn("error", F.when(used.isNull(), F.lit(failure)))
        .withColumn("pages", page_structs(F.col("__pages")))
        .drop("__text", "__pages")
        .withColumn("metadata", F.when(F.col("error").isNull(), metadata))
        .withColumn("warnings", warnings)
        .withColumn("seconds", F.lit(0.0))
    )


def metadata_error(names: Sequence[str], errors: Sequence[str]) -> str:
    return errors[0] if len(names) == 1 else f"Both extractors failed to get metadata: {errors[-1]}"


def read_metadata(files: DataFrame, chain: Sequence[str | Backend] = ("utf8", "latin1"),
                  lines_per_page: int | None = None, timeout_seconds: float | None = None) -> DataFrame:
    """Adds ``method, error, metadata`` to each file row. The back ends are
    tried in order, as for extraction, but no page is made: the bundled ones
    count page breaks in the bytes, others are asked for their metadata."""
    if not chain:
        raise ValueError("At least one extractor is needed")
    if not all(isinstance(backend, str) for backend in chain):
        backends = [_TextBackend(b, lines_per_page) if isinstance(b, str) else b for b in chain]

        def facts(content: bytes | None) -> dict[str, Any]:
            return _metadata_one(backends, content, timeout_seconds)

        return _per_document(files, METADATA, facts, len)
    content, used, text = F.col("content"), F.col("method"), F.col("content").cast("string")
    method = F.lit(None).cast("string")
    for name in reversed(chain):
        method = F.when(can_read(name, content), F.lit(name)).otherwise(method)
    cut = "\f" if lines_per_page is None else "\n"
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(cut), F.lit("")))
    page_count = breaks + 1 if lines_per_page is None else F.floor(breaks / F.lit(lines_per_page)) + 1
    given = {"page_count": page_count, "encrypted": F.lit(False), "file_size_bytes": F.col("size").cast("bigint")}
    metadata = F.struct(*[given.get(name, F.lit(None)).cast(dtype).alias(name) for name, dtype in PDF_FIELDS])
    failure = metadata_error(chain, [f"Failed to extract metadata: content is not {name} text" for name in chain])
    return files.withColumn("method", method).withColumn("error", F.when(used.isNull(), F.lit(failure))).withColumn(
        "metadata", F.when(used.isNotNull(), metadata))


def probe(files: DataFrame, backends: Sequence[str | Backend], timeout_seconds: float | None = None) -> DataFrame:
    """Adds ``readable``, a map from the name of each back end to whether it
    can read the document. Nothing is extracted by those that have a probe."""
    names = [b if isinstance(b, str) else b.name for b in backends]
    others = [b for b in backends if not isinstance(b, str)]
    if others:
        def ask(content: bytes | None) -> dict[str, Any]:
            return {"__asked": [content is not None and _can_read(b, content, timeout_seconds) for b in others]}

        files = _per_document(files, "__asked array<boolean>", ask, len)
    asked = {b.name: F.col("__asked")[i] for i, b in enumerate(others)}
    pairs = [part for name in names for part in (F.lit(name), asked[name] if name in asked else can_read(name, F.col("content")))]
    return files.withColumn("readable", F.create_map(*pairs)).drop("__asked")


class _TextBackend:
    """The bundled back ends for chains that also hold Python ones."""

    def __init__(self, name: str, lines_per_page: int | None):
        self.name = name
        self.lines_per_page = lines_per_page

    def extract(self, content: bytes) -> tuple[dict[str, Any], list[Page]]:
        text = content.decode("utf-8" if self.name == "utf8" else "latin-1")
        if self.lines_per_page is None:
            return {}, [Page(part) for part in text.split("\f")]
        lines, n = text.split("\n"), self.lines_per_page
        return {}, [Page("\n".join(lines[i:i + n])) for i in range(0, len(lines), n)]

    def metadata(self, content: bytes) -> dict[str, Any]:
        if self.name == "utf8":
            content.decode("utf-8")
        if self.lines_per_page is None:
            return {"page_count": content.count(b"\f") + 1}
        return {"page_count": content.count(b"\n") // self.lines_per_page + 1}


@contextmanager
def _deadline(seconds: float | None):
    """Interrupts Python code that runs past the limit. A hang inside native
    code is not interruptible; bound that with task-level limits."""
    if not seconds:
        yield
        return

    def expired(signum, frame):
        raise TimeoutError(f"extraction took more than {seconds:g} s")

    previous = signal.signal(signal.SIGALRM, expired)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, previous)


def _extract_one(chain: list[Backend], content: bytes, timeout: float | None) -> dict[str, Any]:
    errors = []
    for backend in chain:
        try:
            with _deadline(timeout):
                metadata, pages = backend.extract(content)
        except Exception as error:
            errors.append(f"PDF extraction failed: {error}")
            continue
        warnings = [fallback_warning(chain[0].name, backend.name)] if errors else []
        rows = []
        for number, page in enumerate(pages, start=1):
            if page.error is not None:
                warnings.append(f"Page {number} extraction failed: {page.error}")
                page = Page(width=page.width, height=page.height)
            rows.append(
                {
                    "page_number": number, "text": page.text or "", "images": page.images,
                    "tables": [t for t in page.tables if t.get("data")],
                    "width": float(page.width), "height": float(page.height),
                }
            )
        facts = {"page_count": len(rows), "encrypted": False, "file_size_bytes": len(content), **metadata}
        return {
            "method": backend.name, "error": None, "metadata": facts, "pages": rows, "warnings": warnings,
        }
    failure = _chain_error([b.name for b in chain], errors)
    return {"method": None, "error": failure, "metadata": None, "pages": None, "warnings": []}


def _facts_of(backend: Backend, content: bytes) -> dict[str, Any]:
    """Metadata of a document, by the back end's own way if it has one."""
    given = {"encrypted": False, "file_size_bytes": len(content)}
    if hasattr(backend, "metadata"):
        return {**given, **backend.metadata(content)}
    metadata, pages = backend.extract(content)
    return {**given, "page_count": len(pages), **metadata}


def _metadata_one(chain: list[Backend], content: bytes | None, timeout: float | None) -> dict[str, Any]:
    errors = ["Failed to extract metadata: no content"]
    for backend in chain if content is not None else ():
        try:
            with _deadline(timeout):
                return {"method": backend.name, "error": None, "metadata": _facts_of(backend, content)}
        except Exception as error:
            errors.append(f"Failed to extract metadata: {error}")
    return {"method": None, "error": metadata_error([b.name for b in chain], errors[-1:]), "metadata": None}


def _can_read(backend: Backend, content: bytes, timeout: float | None) -> bool:
    try:
        with _deadline(timeout):
            if hasattr(backend, "can_read"):
                return bool(backend.can_read(content))
            _facts_of(backend, content)
            return True
    except Exception:
        return False


def _extract_python(files: DataFrame, chain: list, lines_per_page: int | None, timeout: float | None) -> DataFrame:
    backends = [_TextBackend(b, lines_per_page) if isinstance(b, str) else b for b in chain]

    def extract(content: bytes | None) -> dict[str, Any]:
        start = time.perf_counter()
        if content is None:
            found = {"method": None, "error": "PDF extraction failed: no content", "metadata": None, "pages": None, "warnings": []}
        else:
            found = _extract_one(backends, content, timeout)
        return {**found, "seconds": time.perf_counter() - start}

    def held(found: dict[str, Any]) -> int:
        return sum(len(page["text"]) for page in found["pages"] or ())

    return _per_document(files, EXTRACTION, extract, held)


def _per_document(files: DataFrame, added: str, work: Callable[[bytes | None], dict[str, Any]],
                  held: Callable[[dict[str, Any]], int]) -> DataFrame:
    """Adds the columns that ``work`` returns for the content of each row. Rows
    are sent on together until their contents and results (``held``) come to
    `OUTPUT_BYTES`, so many small documents are one batch and no batch is large."""
    new = StructType.fromDDL(added)
    schema = StructType([*files.schema.fields, *new.fields])
    arrow_new, bound = to_arrow_schema(new), OUTPUT_BYTES

    def packed(batch: pa.RecordBatch, start: int, found: list[dict[str, Any]]) -> pa.RecordBatch:
        extra = [pa.array([f[field.name] for f in found], type=field.type) for field in arrow_new]
        return pa.RecordBatch.from_arrays(
            [*batch.slice(start, len(found)).columns, *extra], schema=pa.schema([*batch.schema, *arrow_new]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, found, size = batch.column(batch.schema.get_field_index("content")), [], 0
            for row in range(batch.num_rows):
                content = contents[row].as_py()
                found.append(work(content))
                size += len(content or b"") + held(found[-1])
                if size >= bound:
                    yield packed(batch, row + 1 - len(found), found)
                    found, size = [], 0
            if found:
                yield packed(batch, batch.num_rows - len(found), found)

    return files.mapInArrow(run, schema)
