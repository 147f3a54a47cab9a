"""URL filter: rules first, then logistic regression on character n-grams.

Host and path are cut into overlapping runs of 3 to 5 bytes, hashed into a
fixed number of weights. The model learns from a small labelled URL table.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docpipe.llm.shared import once, share
from docpipe.llm.shingles import mix

#: Weights of the model, and the lengths of n-grams.
BITS = 16
GRAMS = (3, 4, 5)
TRAIN_ROWS = 4_000


@dataclass(frozen=True)
class UrlRule:
    """Fits the host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
    A-Z lower-cased; path: from there up to ``?``, ``#`` or the end. Both are
    empty without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(has, host).otherwise(""), F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text) if text is None else text.when(fits, rule.text)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    return (text, verdict) if text is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def grams(hosts: list[str], paths: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, weight index) of every distinct n-gram of a row."""
    rows, hashes = [], []
    for part, texts in enumerate((hosts, paths)):
        data = [b"\x02" + t.encode("utf-8", "surrogatepass") + b"\x03" for t in texts]
        flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(len(data)), [len(d) for d in data])
        for n in GRAMS:
            if len(flat) >= n:
                h = np.full(len(flat) - n + 1, 2 * n + part, np.uint64)
                for k in range(n):
                    h = h * np.uint64(0x100000001B3) ^ flat[k : k + len(h)]
                inside = row[: len(h)] == row[n - 1 :]
                rows.append(row[: len(h)][inside])
                hashes.append(mix(h[inside]) >> np.uint64(64 - bits))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.unique(np.concatenate(rows).astype(np.int64) << bits | np.concatenate(hashes).astype(np.int64))
    return both >> bits, both & ((1 << bits) - 1)


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability that the URL is to be blocked."""
        row, index = grams(hosts, paths)
        count = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
        margin = np.bincount(row, self.weights[index], len(hosts)) / np.sqrt(count) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit_urls(hosts: list[str], paths: list[str], blocked: list[int], steps: int = 150, rate: float = 2.0, ridge: float = 1e-4) -> UrlModel:
    """Logistic regression by gradient descent over all rows; deterministic.
    Without both labels every URL gets the label there is, or 0."""
    y = np.array(blocked, float)
    if len(y) == 0 or y.min() == y.max():
        return UrlModel(np.zeros(1 << BITS), 10.0 if len(y) and y[0] else -10.0)
    row, index = grams(hosts, paths)
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    weights, bias = np.zeros(1 << BITS), 0.0
    for _ in range(steps):
        margin = np.bincount(row, weights[index], len(y)) * value + bias
        miss = y - 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        step = np.bincount(index, (miss * value)[row], 1 << BITS) / len(y)
        weights += rate * 10 * step - ridge * weights
        bias += rate * miss.mean()
    return UrlModel(weights, bias)


def ruled(urls: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``urls`` (with url) and host, path, rule, rule_verdict."""
    host, path = host_and_path(F.col("url"))
    parts = urls.withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return parts.withColumns({"rule": rule, "rule_verdict": verdict})


def labelled_urls(urls: DataFrame, rules: tuple[UrlRule, ...] = RULES, bound: int = TRAIN_ROWS) -> DataFrame:
    """A small labelled table from the data: at most ``bound`` different host
    and path pairs that a rule decides, in the order of a hash."""
    rows = ruled(urls.select("url"), rules).where("rule_verdict is not null").select(
        "host", "path", (F.col("rule_verdict") == "block").cast("int").alias("blocked")).distinct()
    return rows.orderBy(F.xxhash64("host", "path"), "host", "path").limit(bound)


def filter_urls(urls: DataFrame, labelled: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``urls`` (page_id, url; other columns are ignored) -> page_id, host,
    path, rule, verdict (allow or block), block_score.

    A rule decides where one fits, the model elsewhere (block from 0.5 on),
    also for null, empty and odd URLs. ``labelled`` (host, path, blocked) is a
    small table and comes to the driver. Repeated rows stay; no shuffle."""
    rows = sorted(tuple(r) for r in labelled.select("host", "path", "blocked").collect())
    held = share(urls.sparkSession, fit_urls([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))

    def work(batches):
        for batch in batches:
            score = once(held).score(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            by_rule = batch.column("rule_verdict").to_pylist()
            verdict = [v or ("block" if s >= 0.5 else "allow") for v, s in zip(by_rule, score)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")),
                                              pa.array(verdict, pa.string()), pa.array(score, pa.float64())],
                                             ["page_id", "host", "path", "rule", "verdict", "block_score"])

    parts = ruled(urls.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), rules)
    return parts.select("page_id", "host", "path", "rule", "rule_verdict").mapInArrow(
        work, "page_id long, host string, path string, rule string, verdict string, block_score double")
