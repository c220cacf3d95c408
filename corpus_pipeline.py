"""From raw documents to token ids: quality, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with all columns of
`documents`; the last returns one row of token counts and digests per document of the mix.  A
stage's decisions are made on its own input.  run() writes every stage to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partyloom.llm import bpe, exact_dedup, mixing, quality, similar
from partyloom.llm.common import materialize, table
from partyloom.llm.queries import VOCAB


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest id of each set of equal texts."""
    return exact_dedup.keep_one(docs, keep="high")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of texts whose five-word shingles have a similarity of 0.8."""
    return similar.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, once or twice."""
    return mixing.apply(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document of the mix."""
    return bpe.digests(docs, VOCAB)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing to target weights", mix_stage),
    ("byte-level BPE", encode_stage),
]
#: The stages hold trained weights, random rounding and merges, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
