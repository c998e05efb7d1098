"""The corpus pipeline: rules, classifier, near-duplicates, mixture and tokens, one stored table after another.

Extra columns are carried along under their own names, whatever they are called, up to the last
stage, which returns ids, digests and token ids; an empty table stays empty at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import bpe, minhash, mixing, quality_mil, quality_rules
from callweave.llm.common import Scratch, owned, read, unused
from callweave.llm.queries import BYTE_BPE, WEIGHTS


def pass_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep: null, empty and very short texts go; equal texts share their fate, whatever their ids."""
    return quality_rules.keep_good(docs)


def pass_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps; it learns from labelled rows of the original table.

    Equal texts share their fate, whatever their ids; a null text is judged as an empty one.
    """
    model = quality_mil.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return quality_mil.keep_predicted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): that of the least id, null ids last.

    Of rows that repeat id and text one stays; texts without words are no copies.
    """
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents repeated by target weights and shuffled; null sources count with the others, repeated ids alike."""
    copy_no, key = unused(docs, "copy_no", "mix_key")
    return mixing.mix(docs, WEIGHTS, copy_col=copy_no, key_col=key).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of them and of what they decode to; null texts have none."""
    return bpe.round_trip(docs, BYTE_BPE, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_rules", pass_rules),
    ("quality_classifier", pass_classifier),
    ("minhash_near_dedup", drop_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
#: The rules' model, the classifier and the links aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage stored on its way, and its predecessor's table, are deleted once its own is stored."""
    docs, before = read(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        on_the_way, own = Scratch(spark), Scratch(spark)
        with owned(on_the_way):
            docs = own.stored(stage(spark, docs, sf_dir), name)
        on_the_way.drop()
        before.drop()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
