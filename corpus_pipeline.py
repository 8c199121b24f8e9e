"""Corpus preparation: language, near duplicates, secrets, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on; the last one
returns token ids. Null and empty texts leave in the first stage, as they have no
language; no other stage drops a document but as a copy of one that stays, or because the
mix draws it no time.

All stages keep extra columns, whatever their names, but the last; an empty table gives an empty table.

A stage first deletes the intermediate tables that the stages before it have left; their
results must have been written, as ``run`` does.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import bpe, langid, mixing, near_dups, secrets
from passagework.llm.common import fresh
from passagework.operators.common import materialize, release


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from ``lang``; those it rejects go.

    Null and empty texts go; repeated rows and ties are judged alike, by text alone. Without
    a labelled text nothing is learned and everything goes. Texts are read whole, one batch in a task.
    """
    release(spark, *WORKING)
    labelled = docs.select("lang", "text").filter("lang is not null and text is not null")
    models = langid.train(labelled)
    (said_as,) = fresh(docs, "_language")
    said = materialize(docs.withColumn(said_as, langid.predicted(spark, models, F.col("text"))), "lang-said")
    levels = langid.levels_of(said.select("lang", F.col(said_as).alias("p")), models.langs)
    return said.filter(~langid.rejected(F.col(said_as), levels)).select(*docs.columns)


#: Labels of the tables that operators write: by language, near duplicates, mix, tokens.
WORKING = ("lang-", "dup-", "edges-", "roots-", "mix-", "bpe-")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8).

    The smallest id stays; repeated rows of that id all stay, as do rows without words or
    without an id, which are linked with nothing. Very long texts are compared on their full sets.
    """
    release(spark, *WORKING)
    return near_dups.near_duplicates(docs).filter("kept").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a sign and ``n_chars`` counted anew.

    Null and empty texts stay as they are, and so do rows without a secret; without a column ``n_chars``
    none is added. A long text costs in proportion to its length.
    """
    release(spark, *WORKING)
    (spans,) = fresh(docs, "_secrets")
    found = secrets.find_secrets(docs, into=spans)
    clear = secrets.redacted(F.col("text"), F.col(spans))
    changed = {"text": clear}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size(spans) > 0, F.length(clear).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns(changed).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is drawn.

    A null source is a source of its own; null ids and repeated rows are drawn like others,
    ties in size go by the hash of the id. Empty texts take no words.
    """
    release(spark, *WORKING)
    return mixing.emitted(mixing.mix(docs)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number; ``bpe.decode`` gives the text back.

    Null and empty texts have no ids; every row stays, repeated ones too. Whole texts are encoded.
    """
    release(spark, *WORKING)
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mix", mix),
    ("tokens", tokens),
]

#: The stages learn models and draw by hash; SQL cannot say them. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
