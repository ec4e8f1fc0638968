"""The corpus pipeline: five stages, each over all rows that its predecessor kept.

1. ``language``: language ID by mixture inference; documents it rejects (no letters, no language) go.
2. ``near_copies``: wide SimHash with pigeonring filtering and exact similarity of 5-word shingles of at least 0.8; the
   smallest id of each group stays.
3. ``repeats``: words in windows of 13 that an earlier document has go, by suffix automata.
4. ``mixture``: sources mixed to weights by entropy balancing; each document comes as often as it is taken.
5. ``pieces``: SentencePiece ids by prefix table.

``run`` applies the stages to the documents table. SQL can't express stages 1, 2 and 5, so ``ORACLE_SQL`` is None and the
stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import kept, table
from corpuscope.llm.languages import identify, train
from corpuscope.llm.mixing import mix
from corpuscope.llm.near_texts import without_copies
from corpuscope.llm.repeats import strip_repeats
from corpuscope.llm.sentencepieces import encoded

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of some language."""
    return identify(docs, train(docs)).where("lang_pred <> 'und'").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return without_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that earlier ones have; ``n_chars`` follows the text."""
    out = strip_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs).withColumn("_copy", F.explode(F.expr("array_repeat(0, int(copies))"))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    import public_tokenizers

    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("near_copies", near_copies), ("repeats", repeats), ("mixture", mixture), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is a table in the shared folder before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
