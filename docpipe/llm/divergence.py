"""How far the sources of a language differ in their words.

Terms are runs of letters and characters outside ASCII, with A-Z lower-cased.
A CountVectorizer with a least number of documents and the greatest vocabulary
size an integer allows makes an exact sparse count vector of each document. Its
terms carry their language, so one fit holds the vocabularies of all languages
and a document's vector has terms of its own language only. The vectors are
summed to sparse rows (language, source, term, count); sources are then
compared on the terms that one of them has, and the terms that neither has add
their number times one constant.

All arithmetic is in integers. Null lang, source and text are ''. Each row is a
document of its own, so repeated rows count again. Languages without a kept
term give pairs of value 0. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.llm.shared import materialize, slices

#: Bytes that are not in a term become spaces, A-Z become a-z. A character
#: outside ASCII has no byte below 0x80, so this holds byte by byte.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A kept term is in at least so many documents of its language.
MIN_DOCS = 30
#: Probabilities are in units of one in so many; each term counts 5 more.
SCALE, PLUS = 1_000_000_000, 5
#: Reported terms of a group.
TOP = 50


def _with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a text by its terms, each with its language before it: neither
    a space nor another character up to '@' is in a term."""
    for batch in slices(batches):
        plain = [text.translate(_PLAIN).strip() for text in batch.column("text").cast(pa.binary()).to_pylist()]
        found = pa.compute.ascii_split_whitespace(pa.array(plain, pa.binary()).cast(pa.string()))
        of = pa.compute.list_parent_indices(found)
        flat = found.flatten()
        some = pa.compute.not_equal(flat, "")
        of, flat = of.filter(some), flat.filter(some)
        named = pa.compute.binary_join_element_wise(batch.column("lang").take(of), flat, " ")
        ends = np.cumsum(np.bincount(of.to_numpy(), minlength=batch.num_rows))
        terms = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), named)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), terms], names=["lang", "source", "terms"])


def fit_vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS) -> CountVectorizerModel | None:
    """The model for ``docs`` (terms); None if no term is in enough documents.
    The kept terms come to the driver and go to all tasks, as this estimator
    does: some 100 bytes each, and their number grows far slower than the text."""
    counter = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=2**31 - 1)
    try:
        return counter.fit(docs.select("terms"))
    except IllegalArgumentException as error:
        if "vocabulary size should be > 0" in str(error):
            return None
        raise


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse sums of the vectors of a batch by group number."""
    for batch in batches:
        vectors, groups = batch.column("vector"), batch.column("g").to_numpy(zero_copy_only=False)
        indices = vectors.field("indices")
        index = indices.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        count = vectors.field("values").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = pa.compute.fill_null(pa.compute.list_value_length(indices), 0).to_numpy(zero_copy_only=False)
        if not len(index):
            continue
        of = np.repeat(groups, lengths)
        order = np.lexsort((index, of))
        of, index, count = of[order], index[order], count[order]
        first = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(index) != 0)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(of[first]), pa.array(index[first]), pa.array(np.add.reduceat(count, first))], names=["g", "term_id", "n"])


def group_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """``docs`` (text, lang, source) -> groups (lang, source, of all rows) and
    counts (lang, source, term, n > 0, of the kept terms)."""
    spark = docs.sparkSession
    text, lang, source = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    plain = docs.select(text, lang, source)
    named = plain.mapInArrow(_with_terms, "lang string, source string, terms array<string>")
    groups = materialize(plain.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")), "divergence-groups")
    model = fit_vocabulary(named, min_docs)
    if model is None:
        return groups, spark.createDataFrame([], "lang string, source string, term string, n long")
    # Summed inside a batch by a hash of the group, which its name then replaces.
    vectors = model.transform(named).select(F.xxhash64("lang", "source").alias("g"), "vector")
    sums = vectors.mapInArrow(_summed, "g long, term_id long, n long").groupBy("g", "term_id").agg(F.sum("n").alias("n"))
    words = spark.createDataFrame(
        pa.table({"term_id": pa.array(range(len(model.vocabulary)), pa.int64()), "word": pa.array(model.vocabulary, pa.string())}))
    named_groups = groups.select(F.xxhash64("lang", "source").alias("g"), "lang", "source")
    counts = sums.join(words, "term_id").join(named_groups, "g").select(
        "lang", "source", F.substring_index("word", " ", -1).alias("term"), "n")
    return groups, materialize(counts, "divergence-counts")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count, floored; null where the language keeps no term."""
    wide = [c.cast("decimal(20,0)") for c in (count + F.lit(PLUS), total + kept * F.lit(PLUS))]
    return (F.call_function("div", wide[0] * F.lit(SCALE).cast("decimal(10,0)"), F.nullif(wide[1], F.lit(0).cast("decimal(20,0)"))) + 1).cast("long")


def _gap(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b))


def shares(groups: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds to the groups ``kept`` (terms of the language) and ``p0`` (of a
    term they lack), and to the counts ``p``, and ``q`` of the language."""
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    langs = whole.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = groups.select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(
        0, ["kept", "lang_total", "total"])
    known = materialize(known.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("kept"))), "divergence-totals")
    placed = counts.join(known, ["lang", "source"]).join(whole, ["lang", "term"])
    placed = placed.select("lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
                           _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"), "p0")
    return known, materialize(placed, "divergence-shares")


def pair_values(known: DataFrame, placed: DataFrame) -> DataFrame:
    """lang, source, item, value of each two sources of a language, both ways.

    With a0 and b0 the shares of a term that a source lacks, the sum over all
    kept terms is kept * |a0 - b0|, and for each term of a |a - b0| - |a0 - b0|,
    for each of b |a0 - b| - |a0 - b0|, and for each of both
    |a - b| - |a - b0| - |a0 - b| + |a0 - b0|: only terms that occur are met."""
    a = known.select("lang", F.col("source").alias("a"), "kept", F.col("p0").alias("a0"))
    b = known.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    pairs = a.join(b, "lang").where("a <> b")
    base = pairs.where("a < b").select("lang", "a", "b", F.coalesce(F.col("kept") * _gap("a0", "b0"), F.lit(0)).alias("v"))
    mine = placed.select("lang", F.col("source").alias("a"), "term", "p", F.col("p0").alias("a0"))
    others = b.select("lang", "b", "b0")
    one = mine.groupBy("lang", "a", "a0", "p").agg(F.count(F.lit(1)).alias("n")).join(others, "lang").where("a <> b")
    one = one.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                     (F.col("n") * (_gap("p", "b0") - _gap("a0", "b0"))).alias("v"))
    theirs = placed.select("lang", F.col("source").alias("b"), "term", F.col("p").alias("q"), F.col("p0").alias("b0"))
    both = mine.join(theirs, ["lang", "term"]).where("a < b").select(
        "lang", "a", "b", (_gap("p", "q") - _gap("p", "b0") - _gap("a0", "q") + _gap("a0", "b0")).alias("v"))
    summed = base.unionByName(one.groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))).unionByName(
        both.groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    return summed.select("lang", ways, "value").select("lang", "w.source", "w.item", "value")


def term_values(placed: DataFrame) -> DataFrame:
    """lang, source, item, value of the terms that a source uses more often
    than its language."""
    return placed.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: each source of
    a language against every other one, and its ``top`` terms."""
    known, placed = shares(*group_counts(docs, min_docs))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"]
    pairs = pair_values(known, placed).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    best = term_values(placed).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.select(*columns).unionByName(best.withColumn("part", F.lit("term")).select(*columns))


#: The same rows in SQL, over all terms of all groups.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT i, lang, source,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30
), g AS (
  SELECT DISTINCT lang, source FROM d
), n AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), c AS (
  SELECT g.lang, g.source, kept.term, coalesce(n.n, 0)::HUGEINT AS n,
    sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total, count(*) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS v,
    sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, kept.term)::HUGEINT AS lang_n, sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang)::HUGEINT AS lang_total
  FROM g JOIN kept USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS p, 1 + (1000000000 * (lang_n + 5)) // (lang_total + 5 * v) AS q FROM c
), pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term
    GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
), items AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM (
    SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
  QUALIFY rank <= 50
)
SELECT lang, source, part, item, value, rank::INT AS rank FROM items
"""
