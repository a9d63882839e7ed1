"""The corpus pipeline: documents through five operators, each stage on all that the one before kept.

1. ``language``: documents whose language cannot be told (no letters, or like none of the
   languages learned from the table's own labels) go.
2. ``near_duplicates``: of each class of exact and near copies the document of the least id stays.
3. ``decontaminate``: contaminated documents go; where a document holds windows of a single
   benchmark item, which does not make it contaminated, the words hit are cut out of it.
4. ``secrets``: spans of secrets are replaced by a mark.
5. ``encode``: byte-level BPE; returns the digest rows of operator 1.

Stages 1 to 4 return the columns of ``documents`` as they are, extra columns included.

Defined results: a null text or one without letters goes in stage 1, empty ones among them; texts
of any length are read whole; rows that repeat an id and a text are copies, of which stage 2
keeps one, and rows that repeat an id with other texts or have none are documents like others;
of equally least rows any one stays, for they are equal in id and text; a table without labels
teaches no language, so that all its documents go; an empty table gives an empty result at every
stage; other columns, nulls in them included, pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticelake.llm import bpe, decontam, langid, neardup, secrets
from latticelake.llm.common import table
from latticelake.session import discard, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.fit(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", redact_secrets), ("encode", encode)]

#: Language models, fuzzy classes and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = after
    return docs
