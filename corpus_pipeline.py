"""A corpus pipeline of five operators: toxicity, near-duplicates, repeated strings, leaked test items, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's documents. The first four return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.llm import bpe_codec, decontaminate, near_dedup, suffix_dedup, toxicity
from graphmill.scratch import cut
from graphmill.shipping import ensure_shipped

#: Bytes of a repeated string; passages of 50 words are longer.
REPEAT_BYTES = 200
VOCABULARY = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the rejection level."""
    ensure_shipped(spark)
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity_scores(docs, model).where(F.col("severity") < toxicity.REJECT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each component of likeness 0.8 on five-word shingles, one row for each id and text.

    The key of a row is its id. Rows without an id, and the texts of an id but for the one of least hash, get a
    key of 62 bits from id and text. Rows without an id and without words stay.
    """
    ensure_shipped(spark)
    digest = F.xxhash64("text")
    unlike = cut(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min(digest).alias("_least"), F.max(digest).alias("_most")).where("_least <> _most").select("_id", "_least"), "unlike")
    made = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    other = F.col("doc_id").isNull() | (F.col("_least").isNotNull() & (digest != F.col("_least")))
    keyed = docs.join(unlike, F.col("doc_id") == F.col("_id"), "left").withColumn("_key", F.when(other, made).otherwise(F.col("doc_id").cast("long"))).drop("_id", "_least")
    found = near_dedup.near_duplicates(keyed.select("_key", "text"), doc_id="_key", words_each=5, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("_key").alias("_gone")).distinct()
    left = keyed.join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    one = F.row_number().over(Window.partitionBy("_key").orderBy(digest))
    blank = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    return left.withColumn("_row", F.when(blank, 1).otherwise(one)).where("_row = 1").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of REPEAT_BYTES bytes that start anywhere else too; n_chars follows."""
    ensure_shipped(spark)
    out = suffix_dedup.remove_repeats(docs, REPEAT_BYTES)
    changed = F.size("removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("n_chars", F.when(changed, F.length("kept_text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))).withColumn("text", text).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    ensure_shipped(spark)
    marked = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(~F.col("contaminated")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of the ids and of the text decoded from them."""
    ensure_shipped(spark)
    coded = bpe_codec.bpe_round_trip(docs, public_tokenizers.path(VOCABULARY), keep_ids=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: SQL can express neither the fitted classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
