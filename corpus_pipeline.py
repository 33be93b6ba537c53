"""The corpus pipeline: language ID, line dedup, near-dedup, packing.

STAGES are (name, function) in order. A function takes the session, the
documents its predecessor kept and the data folder, and returns a DataFrame; all
but the last return the columns of `documents`. Each result is written before
the next stage reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import langid, linededup, minhash, packing
from folioframe.llm.common import free_name
from folioframe.llm.queries import WORD_BPE
from folioframe.session import configure, cut

# Sites that make a line boilerplate.
MIN_SITES = 10


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; a missing `lang` is filled in."""
    found, score = free_name("language found", docs.columns), free_name("its score", docs.columns)
    judged = langid.identify(docs, langid.learn(docs), extra=tuple(docs.columns), into=(found, score))
    return judged.where(F.col(found) != "und").withColumn("lang", F.coalesce("lang", F.col(found))).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate; one that loses every line goes."""
    clean = linededup.drop_shared_lines(docs, min_sites=MIN_SITES)
    emptied = (F.col("lines_out") < F.col("lines_in")) & (F.trim("text") == "")
    return clean.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    configure(spark)
    return minhash.kept_documents(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens."""
    return packing.pack_with_library(docs, WORD_BPE)


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("best-fit packing", best_fit)]

# Language ID and HyperMinHash are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
