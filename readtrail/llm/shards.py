"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash of the document id.  A bucket over the
byte limit splits on one more bit, and only that bucket, until all fit.  The shard of a
document is thus the shortest prefix of its hash whose bucket fits the limit.  All depths
up to a few bits past the expected one are summed in a single aggregate over small cells;
only what is still too large there goes to deeper rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readtrail.llm.common import staged, whole_text, with_positions

HASH_BITS = 60
LIMIT_BYTES = 64 << 20
SPARE_BITS = 4  # depth of a round past log2(total / limit)


def prefix_hash(*columns: str) -> Column:
    """The leading 60 bits of an md5 of the columns, as a long; nulls hash as a mark of their own."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x01", *parts)), 1, HASH_BITS // 4), 16, 10).cast("long")


def _bits(depth: Column) -> Column:
    return F.substring(F.lpad(F.conv(F.col("_hash").cast("string"), 10, 2), HASH_BITS, "0"), F.lit(1), depth)


def _round(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Depth and bytes of the fitting bucket for each prefix of `high` bits; null depth: none fits."""
    cell = F.shiftrightunsigned("_hash", HASH_BITS - high)
    cells = rows.groupBy(cell.alias("_cell")).agg(F.sum("n_bytes").alias("_sum"))
    at = F.explode(F.sequence(F.lit(low), F.lit(high)))
    levels = cells.withColumn("_depth", at)
    prefix = F.expr(f"shiftrightunsigned(_cell, {high} - _depth)")
    sums = levels.groupBy("_depth", prefix.alias("_prefix")).agg(F.sum("_sum").alias("_bytes"))
    fits = F.col("_bytes") <= limit
    best = (
        levels.withColumn("_prefix", prefix).join(sums, ["_depth", "_prefix"])
        .groupBy("_cell").agg(F.min(F.when(fits, F.struct("_depth", "_bytes"))).alias("_fit"))
    )
    # the directory, a few cells per shard, goes to the texts: they are shuffled once, to be written
    return rows.withColumn("_cell", cell).join(F.broadcast(best), "_cell").drop("_cell")


def assign_shards(docs: DataFrame, limit: int = LIMIT_BYTES, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`docs` with `n_bytes`, `shard` (the prefix bits), `depth` and `shard_bytes`.

    A shard holds at most `limit` bytes of text (null: 0), unless one document alone is
    larger.  Rows of one key hash alike at any depth; where they outgrow the limit together
    (repeated ids, null ids), they are dealt by running number into shards with a suffix
    `-n`, of as many rows as fit when each is taken as large as the largest.
    """
    spark = docs.sparkSession
    own = ("n_bytes", "shard", "depth", "shard_bytes")
    base = docs.drop(*own)
    rows = base.withColumn("n_bytes", F.octet_length(whole_text()).cast("long")).withColumn("_hash", prefix_hash(*key))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low = 0
    done: list[DataFrame] = []
    step = max(1, math.ceil(math.log2(max(1.0, total / limit)))) + SPARE_BITS
    while True:
        high = min(HASH_BITS, low + step)
        found = _round(rows, low, high, limit)
        done.append(
            found.where(F.col("_fit").isNotNull()).select(
                *base.columns, "n_bytes", _bits(F.col("_fit._depth")).alias("shard"),
                F.col("_fit._depth").alias("depth"), F.col("_fit._bytes").alias("shard_bytes"),
            )
        )
        rest = found.where(F.col("_fit").isNull()).drop("_fit")
        left = rest.agg(F.count_distinct("_hash"), F.count("*")).first()
        if not left[1]:
            break
        rows = staged(rest, "shard-rest")
        if left[1] == left[0] and rows.agg(F.min("n_bytes")).first()[0] > limit or high == HASH_BITS:
            done.append(_alike(rows, limit, base.columns))
            break
        low, step = high, SPARE_BITS * 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _alike(rows: DataFrame, limit: int, columns: list[str]) -> DataFrame:
    """Rows whose full hashes agree, or single documents over the limit."""
    numbered = with_positions(rows, [F.col("_hash"), F.col("n_bytes")], "shard-alike")
    groups = numbered.groupBy("_hash").agg(F.min("_position").alias("_first"), F.max("n_bytes").alias("_most"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("_most"), F.lit(1)))).cast("long")
    split = numbered.join(groups, "_hash").withColumn(
        "_n", F.floor((F.col("_position") - F.col("_first")) / each).cast("long")
    )
    sums = split.groupBy("_hash", "_n").agg(F.sum("n_bytes").alias("shard_bytes"))
    return split.join(sums, ["_hash", "_n"]).select(
        *columns, "n_bytes", F.concat(_bits(F.lit(HASH_BITS)), F.lit("-"), F.col("_n")).alias("shard"),
        F.lit(HASH_BITS).alias("depth"), "shard_bytes",
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder `shard=<bits>` per shard; a shard is one task's file."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, columns: str = "doc_id long, text string") -> DataFrame:
    """The rows of written shards, with what the files say of each: n_bytes, shard, depth, shard_bytes.

    The columns must hold `text`.  The shard is the name of the folder that a row's file lies in.
    """
    rows = spark.read.schema(f"{columns}, shard string").parquet(path).withColumns({
        "n_bytes": F.octet_length(whole_text()).cast("long"),
        "shard": F.coalesce("shard", F.lit("")),  # the one shard of no bits has no name of its own
    })
    sizes = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    depth = F.length(F.substring_index("shard", "-", 1)).alias("depth")
    return rows.join(sizes, "shard").select("*", depth)


def oracle_sql(limit: int = LIMIT_BYTES, deepest: int = 24) -> str:
    """DuckDB SQL of the same assignment, where no bucket needs more than `deepest` bits."""
    return f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, {HASH_BITS // 4}))::BIGINT AS h
  FROM documents
), levels AS (
  SELECT d AS depth, (h >> ({HASH_BITS} - d)) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes
  FROM rows, range(0, {deepest + 1}) t(d) GROUP BY 1, 2
), best AS (
  SELECT doc_id, n_bytes, h, min(depth)::INT AS depth
  FROM rows JOIN levels ON prefix = (h >> ({HASH_BITS} - depth)) WHERE shard_bytes <= {limit} GROUP BY ALL
)
SELECT doc_id, n_bytes, substr(lpad(bin(h), {HASH_BITS}, '0'), 1, best.depth) AS shard, best.depth, shard_bytes
FROM best JOIN levels ON levels.depth = best.depth AND prefix = (h >> ({HASH_BITS} - best.depth))
"""
