"""The stages of the pipeline against plain recomputation, odd rows included."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docpipe.llm.labelled import held_out
from docpipe.llm.mixing import mix_plan
from docpipe.llm.quality import score_quality, train_quality
from docpipe.llm.queries import tokenizer_path
from docpipe.llm.secrets import SecretFinder
from tests.llm.test_documents import ODD, brute_components

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
SECRET = "password = 'abcdefABCDEF12345' and deadbeefdeadbeef00 end. "


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with odd rows, and columns that clash with those of stages."""
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame(
        [(None if i is None else 10_000 + i, t, "en", None if i == 4 else "odd", None) for i, t in ODD if t is None or len(t) < 100_000]
        + [(20_000 + i, SECRET + f"some words about topic {i} are here. " * 9, "en", "odd", 5) for i in range(3)], docs.schema)
    every = docs.unionByName(odd).withColumns({c: F.lit("clash") for c in ("score", "size", "target", "component_id", "kind")})
    every.coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF_DIR}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, folder)
    model = train_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    judged = score_quality(docs.select("doc_id", "text"), model)
    good = Counter(tuple(r) for r in judged.where("predicted = 1").select("doc_id", "text").collect())
    assert kept.columns == docs.columns and rows_of(kept.select("doc_id", "text")) == good and good
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").where(held_out(F.col("doc_id"))).collect()}
    told = {r.doc_id: r.predicted for r in judged.collect() if r.doc_id in truth}
    assert sum(told[i] == truth[i] for i in told) >= 0.8 * len(told)

    single = corpus_pipeline.keep_one_of_near_copies(spark, docs, folder)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    component = brute_components([r for r in rows if r[0] is not None])
    assert single.columns == docs.columns
    assert rows_of(single.select("doc_id", "text")) == Counter(r for r in rows if r[0] is None or component[r[0]][1] == r[0])

    clean, finder = corpus_pipeline.redact(spark, docs, folder), SecretFinder()
    assert clean.columns == docs.columns and clean.count() == docs.count()
    found = {r.doc_id: r for r in clean.collect()}
    assert all("abcdefABCDEF12345" not in (r.text or "") for r in found.values()) and "[assign]" in found[20_000].text
    assert all(found[i].text == text for i, text in rows if i is not None and not finder.find(text))

    mixed = corpus_pipeline.mix(spark, docs, folder)
    copies = Counter({r.doc_id: 0 for r in docs.collect()})
    for r in mix_plan(docs.select("doc_id", "text", "source")).collect():
        copies[r.doc_id] += r.copies
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == +copies

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for r in corpus_pipeline.tokenize(spark, docs.where("doc_id >= 10000"), folder).collect():
        want = tokenizer.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want) and bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in want)


def test_whole_run_and_empty_tables(spark, folder, tmp_path):
    done = corpus_pipeline.run(spark, folder)
    assert done.columns == ["doc_id", "n_tokens", "ids"] and done.count() > 50
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
