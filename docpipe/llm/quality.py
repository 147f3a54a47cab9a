"""Quality of documents: an additive model on features of the whole text."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.gam import Gam, fit
from docpipe.llm.labelled import held_out, training_rows
from docpipe.llm.shared import once, share, slices

#: Rows that a model is fitted on at most.
TRAIN_ROWS = 8_000
#: Documents with at least this score are kept.
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digits", "punctuation", "marks", "bars", "symbols",
    "line_words", "repeated_lines", "distinct_words", "top_word", "halves", "endings", "compressed", "doubled_marks",
)
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_DIGIT = re.compile(r"[0-9]+")
_END = re.compile(r"[.!?](?=\s|$)")
_DOUBLED = re.compile(r"[!?]{2,}")
_COMMON = str.maketrans({c: None for c in ".,;:!?'\"-()"})
#: Bytes by which compressibility is measured, in pieces over the whole text.
PIECE = 1 << 16


def _spread(parts: list[str]) -> int:
    return sum(map(len, parts))


def features(text: str | None) -> list[float]:
    """Ratios of one whole text; all are finite, 0 for an empty one."""
    text = text or ""
    n = len(text)
    words = text.split()
    if not words:
        return [float(np.log1p(n)), *[0.0] * (len(FEATURES) - 1)]
    count = len(words)
    lines = [line for line in text.split("\n") if line.strip()]
    lower = [w.lower() for w in words]
    seen: dict[str, int] = {}
    for w in lower:
        seen[w] = seen.get(w, 0) + 1
    letters = sum(map(len, words))
    data = text.encode("utf-8", "surrogatepass")
    packed = sum(len(zlib.compress(data[i : i + PIECE], 1)) for i in range(0, len(data), PIECE))
    plain = sum(text.count(c) for c in ".,;:")
    marks = text.count("!") + text.count("?")
    bars = text.count("|")
    other = sum(text.count(c) for c in "<>{}[]#*_=~^$%&@/\\+")
    return [
        float(np.log1p(n)), float(np.log1p(count)), letters / count,
        _spread(_UPPER.findall(text)) / letters, _spread(_DIGIT.findall(text)) / letters, plain / count, marks / count,
        bars / count, other / count, float(np.log1p(count / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)),
        len(seen) / count, max(seen.values()) / count, _halves(lower), len(_END.findall(text)) / count,
        packed / len(data), len(_DOUBLED.findall(text)) / count,
    ]


def _halves(words: list[str]) -> float:
    """Share of neighbouring words seen before, side by side."""
    pairs = list(zip(words, words[1:]))
    return 1 - len(set(pairs)) / len(pairs) if pairs else 0.0


def _featured(batches):
    for batch in slices(batches):
        rows = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])


def train_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int = TRAIN_ROWS) -> Gam:
    """Fits the model on the texts of a bounded sample of labelled rows. The
    sample has at most ``bound`` ids and is broadcast to the documents. Of rows
    that repeat an id the one with the least features is learned from."""
    chosen = F.broadcast(training_rows(labels, target, bound))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    featured = rows.select("doc_id", "text").mapInArrow(_featured, "doc_id long, x array<double>")
    sample = sorted(featured.groupBy("doc_id").agg(F.min("x").alias("x")).join(chosen, "doc_id").collect(), key=lambda r: r.doc_id)
    x = np.array([r.x for r in sample], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.label for r in sample], float))


def score_quality(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (with text; all columns stay) with score (0 to 1) and predicted
    (1 from ``threshold`` on). Null and blank texts get the score of a text
    without words. The model, of a few thousand numbers, goes along. No
    shuffle."""
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    held = share(docs.sparkSession, model)

    def work(batches):
        for batch in slices(batches):
            x = np.array([features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
            score = once(held).score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                [*columns, "score", "predicted"])

    source = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", score double, predicted int"
    return source.mapInArrow(work, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train_quality(docs, labels, bound=bound)
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
