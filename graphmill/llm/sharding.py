"""Sharding by proportional stratified interleaving.

Within each stratum (source) rows are put in seeded random order and ranked; a row's
fractional rank is (rank + 1/2) / rows of its stratum. Sorting all rows by fractional
rank interleaves the strata in proportion, and cutting that order into equal runs gives
shards that each match the mixture. Row counts of shards differ by one at most (law
``rows``).

Ranks come from range-partitioned sorts: rows are sorted by (stratum, random key) across
tasks, each task numbers its rows, and the small table of counts per task and stratum
gives the offsets. No stratum is gathered in one task, however large. The sorted rows are
written before they are numbered, as a second run of a range sort may cut elsewhere.

Null texts have size 1 and checksum 0; null strata are a stratum of their own; null and
repeated ids are ordinary rows (ties are ordered by checksum and size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.scratch import cut


def _numbered(rows: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """``rows`` with ``_rank``, the 0-based position of the row in ``order`` among those equal in ``by``, and ``_n``, their number.

    ``order`` must begin with ``by``.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_place", F.monotonically_increasing_id()), "ranked").withColumn("_task", F.shiftright("_place", 33))
    groups = placed.groupBy("_task", *by).agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select(
        F.col("_task").alias("_of"),
        *[F.col(c).alias(f"_of{c}") for c in by],
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy(*by)).alias("_n"),
    )
    on = F.col("_task") == F.col("_of")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_of{c}"))
    return placed.join(offsets, on).select(*rows.columns, (F.col("_place") + F.col("_shift")).alias("_rank"), "_n")


def stratified_shards(df: DataFrame, shards: int, stratum: str = "source", doc_id: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes + 1), text_crc32, stratum, shard, slot (position within the shard)."""
    content = F.coalesce(F.encode(F.col(f"`{text}`").cast("string"), "UTF-8"), F.lit(b""))
    rows = df.select(
        F.col(f"`{doc_id}`").alias("_id"),
        F.col(f"`{stratum}`").cast("string").alias("_stratum"),
        (F.octet_length(content) + F.lit(1)).cast("long").alias("_size"),
        F.crc32(content).alias("_crc"),
    ).withColumn("_key", F.xxhash64(F.lit(seed), "_id", "_crc", "_size"))
    ties = ["_key", "_id", "_crc", "_size"]
    strata = _numbered(rows, ["_stratum", *ties], ["_stratum"]).withColumn("_fraction", (2 * F.col("_rank") + 1) / (2 * F.col("_n")))
    placed = _numbered(strata.select(F.lit(0).alias("_all"), "_fraction", "_stratum", *ties), ["_all", "_fraction", "_stratum", *ties], ["_all"])
    return placed.withColumn("_shard", F.expr(f"(_rank * {int(shards)}) div _n")).select(
        F.col("_id").alias(doc_id), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_stratum").alias(stratum),
        F.col("_shard").cast("int").alias("shard"), F.expr(f"_rank - (_shard * _n + {int(shards) - 1}) div {int(shards)}").alias("slot"),
    )
