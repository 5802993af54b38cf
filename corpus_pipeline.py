"""A corpus pipeline out of the operators: STAGES in order, each on all that the one before it kept.

Defined results: a null text counts as empty; empty texts are copies of each other, so one stays; rows that repeat an
id and text are one document; an empty table gives an empty result. Columns that documents has beyond its own stay to
the end; a column named ids, n_tokens or decoded is replaced by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.bpe import encode_table
from loomspark.llm.common import discard, written
from loomspark.llm.exact_dedup import drop_exact_copies
from loomspark.llm.mixing import Mixture, shuffled
from loomspark.llm.queries import tokenizer_path
from loomspark.llm.similar import drop_similar
from loomspark.llm.toxicity import drop_toxic
from loomspark.session import read_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard of at least 0.8) one document stays: SimHash of long
    fingerprints with pigeonring filtering, and the sets themselves at last."""
    return drop_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    return shuffled(Mixture(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids and the text that they decode to, in place of the text."""
    coded = encode_table(docs.drop("n_tokens"), tokenizer_path(), decoded_col="decoded")
    return coded.withColumn("n_tokens", F.size("ids")).drop("text")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mixing),
    ("bpe", tokens),
]

#: SQL can't express the fitted model, the fingerprints or the tokenizer; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
