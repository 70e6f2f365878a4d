"""From raw documents to packed training sequences: five stages, each on all that the last one kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes what a stage returns to the shared folder, reads it back, and deletes it
when the next stage has been written.

Null and empty texts go in the first stage, as they have no letters; null languages and sources stay what they are;
rows with equal or null ids are documents of their own; extra columns of any name are kept by all stages but the
last; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, langid, mixing, simhash, token_files
from quillon.llm.base import discard, fresh, materialize, table
from quillon.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language go on; `lang` becomes the one predicted from the text by a model
    that learns from the documents' own labels, and stays as it is where nothing could be learned.
    Texts without letters go."""
    name, = fresh(docs, "langid")
    found = langid.identify(docs, docs, name)
    known = F.col(f"{name}.lang_pred") != langid.UNKNOWN
    letters = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    return found.filter(known | letters).withColumn("lang", F.when(known, F.col(f"{name}.lang_pred")).otherwise(F.col("lang"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with
    the smallest id stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: copies are rows with the same id."""
    return mixing.apply(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; doc_id, start, n_tokens and ids_crc32 of each row, read back from them."""
    return token_files.read(token_files.write(docs, tokenizer_path()))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: Language models, SimHash components and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
