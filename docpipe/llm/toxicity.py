"""Toxicity of documents by a weighted lexicon.

Texts are folded first: lower case, and look-alike letters of other scripts,
compatibility forms and digits in place of letters go to plain letters, all else
to a space. Accents stay: they tell words apart. An Aho-Corasick automaton finds the lexicon's terms at word starts and
the exception phrases; a hit inside an exception phrase does not count. The sum
of weights is related to the length, and a logistic curve makes it a score.
The lexicon is learned from labelled documents: word stems and whole words that
are far more frequent in toxic ones than chance allows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.labelled import held_out, training_rows
from docpipe.llm.shared import once, share, slices

TRAIN_ROWS = 20_000
THRESHOLD = 0.5
#: Terms of a lexicon at most: the strongest ones.
LEXICON_TERMS = 4_000
STEMS = (4, 5, 6, 7)
#: Phrases in which a term is no insult.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "sore loser bracket")

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ѵ": "v", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "ℯ": "e", "ℴ": "o",
}
#: Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


class _Folds(dict):
    """Code point -> plain letter, the letter itself, nothing or a space;
    filled as code points come up."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = SUBSTITUTES.get(c, LOOKALIKES.get(c, c))
        if not c.isascii():
            c = "".join(LOOKALIKES.get(x, SUBSTITUTES.get(x, x)) for x in unicodedata.normalize("NFKC", c).lower())
            if unicodedata.category(chr(code)) in ("Cf", "Mn", "Me"):
                c = ""
        if len(self) > 100_000:
            self.clear()
        self[code] = out = "".join(x if x.isalpha() else " " for x in c)
        return out


_FOLDS = _Folds()


def fold(text: str | None) -> str:
    """Folded words, each with a space before it, and one at the end."""
    return " " + " ".join((text or "").translate(_FOLDS).split()) + " "


def terms(text: str | None) -> set[str]:
    """Candidates of one text: stems as " stem", whole words as " word "."""
    out = set()
    for word in set(fold(text).split()):
        if len(word) >= 3:
            out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in STEMS if len(word) >= n)
    return out


@dataclass
class ToxicModel:
    weights: dict[str, float]
    curve: tuple[float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def __post_init__(self) -> None:
        self._machine = None

    def __getstate__(self):
        return {"weights": self.weights, "curve": self.curve, "exceptions": self.exceptions, "_machine": None}

    def measure(self, text: str | None) -> tuple[float, int]:
        """Sum of the weights of the words hit (the greatest term of each
        word), and the number of words."""
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                self._machine.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                term = fold(phrase)
                self._machine.add_word(term, (len(term), None))
            self._machine.make_automaton()
        folded = fold(text)
        words = folded.count(" ") - 1 if len(folded) > 2 else 0
        if not len(self._machine):
            return 0.0, words
        hits: dict[int, float] = {}
        excused = []
        for end, (length, weight) in self._machine.iter(folded):
            start = end - length + 1
            if weight is None:
                excused.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        for low, high in excused:
            for start in [s for s in hits if low <= s < high]:
                del hits[start]
        return sum(hits.values()), words

    def score(self, measured: list[tuple[float, int]]) -> np.ndarray:
        x = signals(measured)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ np.array(self.curve[1:]), -40, 40)))


def signals(measured: list[tuple[float, int]]) -> np.ndarray:
    """Weight per hundred words, and weight, both on a log scale."""
    m = np.array(measured, float).reshape(-1, 2)
    return np.column_stack([np.log1p(100 * m[:, 0] / (m[:, 1] + 20)), np.log1p(m[:, 0])])


def _curve(x: np.ndarray, y: np.ndarray, prior: float = 1e-2) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.array([-2.0, 0.0, 0.0])
    if len(y) and y.min() != y.max():
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + prior * np.eye(3)
            step = np.linalg.solve(h, a.T @ (y - p) - prior * beta)
            beta = beta + np.clip(step, -2, 2)
    return tuple(float(b) for b in beta)


def _counted(batches):
    """Documents with each term, by label, counted in the task."""
    counts = (Counter(), Counter())
    for batch in slices(batches):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            counts[label].update(terms(text))
    names = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][t] for t in names], pa.int64()),
                                      pa.array([counts[0][t] for t in names], pa.int64())], ["term", "toxic", "clean"])


def learn_lexicon(sample: DataFrame, size: int = LEXICON_TERMS) -> dict[str, float]:
    """``sample`` (text, label) -> weight by term: the log odds of toxic over
    clean documents, for terms whose likelihood ratio beats the number of
    terms tried. The ``size`` strongest come to the driver."""
    counts = sample.mapInArrow(_counted, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n1, n0 = (int(v or 0) for v in sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first())
    if not n1 or not n0:
        return {}
    tried = F.lit(float(np.log((n1 + n0) * 100.0)))
    share, both = n1 / (n1 + n0), F.col("toxic") + F.col("clean")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (both * F.lit(p)))).otherwise(0.0)
    ratio = part(F.col("toxic"), share) + part(F.col("clean"), 1 - share)
    weight = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    rows = counts.withColumns({"ratio": ratio, "weight": weight}).where(
        (F.col("ratio") > tried + 1) & (F.col("toxic") >= 8 * F.col("clean")) & (F.col("weight") > 0))
    return {r.term: float(r.weight) for r in rows.orderBy(F.desc("ratio"), "term").limit(size).collect()}


def train_toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic", bound: int = TRAIN_ROWS,
                   exceptions: tuple[str, ...] = EXCEPTIONS) -> ToxicModel:
    """Learns lexicon and curve from at most ``bound`` labelled documents. Of
    rows that repeat an id all count in the lexicon, the least toxic one in the
    curve."""
    chosen = F.broadcast(training_rows(labels, target, bound))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(chosen, "doc_id").select("doc_id", "text", "label")
    model = ToxicModel(learn_lexicon(sample), (-2.0, 0.0, 0.0), exceptions)
    held = share(docs.sparkSession, model)

    def measured(batches):
        toxic = once(held)
        for batch in slices(batches):
            m = [toxic.measure(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([w for w, _ in m], pa.float64()),
                                              pa.array([n for _, n in m], pa.int64()), batch.column("label")],
                                             ["doc_id", "weight", "words", "label"])

    least = F.min(F.struct("weight", "words", "label")).alias("r")
    rows = sample.mapInArrow(measured, "doc_id long, weight double, words long, label int").groupBy("doc_id").agg(least).select("r.*").collect()
    rows = sorted((r.weight, r.words, r.label) for r in rows)
    model.curve = _curve(signals([r[:2] for r in rows]), np.array([r[2] for r in rows], float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text; other columns are ignored) -> doc_id, weight,
    words, score, predicted. Null and blank texts have weight 0 and no words.
    The lexicon has a bounded size and goes along. No shuffle."""
    held = share(docs.sparkSession, model)

    def work(batches):
        toxic = once(held)
        for batch in slices(batches):
            m = [toxic.measure(t) for t in batch.column("text").to_pylist()]
            score = toxic.score(m)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([w for w, _ in m], pa.float64()), pa.array([n for _, n in m], pa.int64()),
                pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "weight", "words", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, weight double, words long, score double, predicted int")


def toxicity_scores(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score_toxicity(docs, train_toxicity(docs, labels, bound=bound))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
