"""The queries of this package: thin digests of its operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docpipe.llm.ann import nearest
from docpipe.llm.bpe import encode_documents
from docpipe.llm.conversations import SQL as CONVERSATIONS_SQL
from docpipe.llm.conversations import damage, repair_report
from docpipe.llm.divergence import SQL as DIVERGENCE_SQL
from docpipe.llm.divergence import source_divergence
from docpipe.llm.embedding_dedup import embedding_groups
from docpipe.llm.jaccard import jaccard_join
from docpipe.llm.licenses import scan_licenses
from docpipe.llm.mixing import SQL as MIXING_SQL
from docpipe.llm.mixing import mix_sizes
from docpipe.llm.quality import quality_scores
from docpipe.llm.secrets import secret_digest
from docpipe.llm.sharding import SQL as SHARDING_SQL
from docpipe.llm.sharding import bytes_law
from docpipe.llm.shared import table
from docpipe.llm.toxicity import toxicity_scores
from docpipe.llm.url_filter import filter_urls, labelled_urls


def tokenizer_path() -> str:
    """The published byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark, sf_dir):
    rows = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op2_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mix_sizes(table(spark, sf_dir, "documents"))


def op4_licenses(spark, sf_dir):
    rows = scan_licenses(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses.name", ",").alias("licenses"))


def op5_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op6_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, labelled_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


def op7_embedding_dedup(spark, sf_dir):
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op8_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secrets(spark, sf_dir):
    return secret_digest(table(spark, sf_dir, "documents"))


def op11_sharding(spark, sf_dir):
    return bytes_law(table(spark, sf_dir, "documents"))


def op12_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return repair_report(damage(rows), rows)


def op13_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_bpe, op2_jaccard_join, op3_mixing, op4_licenses, op5_ann, op6_url_filter, op7_embedding_dedup, op8_quality,
             op9_toxicity, op10_secrets, op11_sharding, op12_conversations, op13_divergence)
    return {f.__name__: f for f in found}


def sql() -> dict[str, str]:
    return {"op3_mixing": MIXING_SQL, "op11_sharding": SHARDING_SQL, "op12_conversations": CONVERSATIONS_SQL, "op13_divergence": DIVERGENCE_SQL}
