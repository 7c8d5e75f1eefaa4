"""The ten ``opN_`` queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import bpe_codec, decontaminate, lang_id, lz_fingerprint, near_dedup, sharding, substring_dedup, suffix_dedup, token_count, toxicity

VOCABULARY = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_count.token_counts(docs, public_tokenizers.path(VOCABULARY))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), words_each=4, percent=80)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe_codec.bpe_round_trip(docs, public_tokenizers.path(VOCABULARY))


#: Bytes of the strings that op1 also counts, without removing them: passages of over 50 words are often shorter than 400 bytes.
SHORTER = 200


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes are removed; ``n_repeated`` counts the bytes that repeated strings of SHORTER bytes cover."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, 400, shorter=SHORTER)
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    n_repeated = F.aggregate("repeated", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return out.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept_bytes")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"), n_repeated.alias("n_repeated"),
    )


def op2_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: shard sizes differ by one row at most; every shard holds each source in proportion."""
    shards = sharding.stratified_shards(documents(spark, sf_dir).select("doc_id", "text", "source"), 16)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    profiles = lang_id.language_profiles(docs.where(~held_out).select("text", "lang"))
    return lang_id.identify_languages(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; ``items`` are the leaked test items, best first."""
    out = decontaminate.contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "contaminated", F.col("leaks.item_id").alias("items"), F.get("leaks", F.lit(0))["score"].alias("best_score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``toxic``: an expected severity of REJECT grades or more."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.toxicity_scores(docs, model)
    return scored.select("doc_id", F.round("severity", 6).alias("severity"), "grade", (F.col("severity") >= toxicity.REJECT).alias("toxic"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_passages(documents(spark, sf_dir).select("doc_id", "text"), 20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.neighbour_fingerprints(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_stratified_shards, op3_token_count, op4_near_duplicates, op5_bpe_round_trip, op6_language_id, op7_decontamination, op8_toxicity, op9_substring_dedup, op10_lz_fingerprint)
}
ORACLES: dict[str, str] = {
    "op4_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS sh FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
comps AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component AS component_id, w.doc_id = component AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN comps ON node = w.doc_id""",
    "op9_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
k AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
f AS (SELECT win, min(struct_pack(d := doc_id, p := i)) AS first FROM k GROUP BY win HAVING count(*) > 1),
again AS (SELECT k.doc_id, k.i FROM k JOIN f ON f.win = k.win WHERE f.first.d <> k.doc_id OR f.first.p <> k.i),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS body FROM each e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.body, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id LEFT JOIN lost ON lost.doc_id = w.doc_id""",
}
