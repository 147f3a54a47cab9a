"""From raw documents to tokens of a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept. All but the last return the columns of documents. Null and blank texts
stay as the quality model judges them; rows without doc_id are no near
duplicates of anything and stay; repeated rows count as one document in the
near-duplicate stage and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpipe.llm.bpe import encode_documents
from docpipe.llm.jaccard import jaccard_components
from docpipe.llm.mixing import mixed_documents
from docpipe.llm.quality import score_quality, train_quality
from docpipe.llm.queries import tokenizer_path
from docpipe.llm.secrets import redact_secrets
from docpipe.llm.shared import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model predicts as good."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies."""
    linked = jaccard_components(docs).where("component_id <> doc_id").select("doc_id")
    return docs.join(linked, "doc_id", "left_anti").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by their kind."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask."""
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document of the mix."""
    return encode_documents(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("secret scans", redact),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokenize),
]

#: The fitted quality model can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each is written to the shared
    folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
