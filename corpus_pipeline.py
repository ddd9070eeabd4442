"""A training corpus from `documents`: five stages, each over all that the one before kept.

Toxic documents go; of each group of near copies one stays; repeated passages are taken out; sources are
mixed to their target weights; the mix is encoded. Neither trained models nor suffix comparison can be said
in SQL, so there is no oracle; tests/llm holds every stage against brute force.

All stages: an empty table gives an empty result; very long texts are handled whole; columns besides those used,
whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlframe.llm import bpe, bwt_dedup, mixing, ngram_join, toxicity
from crawlframe.llm.common import drop, read, scratch, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less those judged toxic. Null and empty texts have the models' base probability; repeated rows are judged alike; without labels all stay."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least doc_id, and one of its repeated rows. Null and empty texts all stay."""
    return ngram_join.keep_first(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the bytes of repeated passages taken out of text. Null texts stay null; a text that is repeated whole becomes empty."""
    return bwt_dedup.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each use of a document's words in a shard. Null and empty texts have no words and go; a null source is one of its own."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens and the hashes of ids and decoded bytes of every row; repeated rows are encoded each."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Each one's result is written and read again; then what it wrote on the way, and the result before, are deleted."""
    docs, before = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scratch() as written:
            docs = settle(stage(spark, docs, sf_dir), "stage")
        drop(spark, [*before, *written[:-1]])
        before = written[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
