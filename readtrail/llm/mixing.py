"""Mixing sources to target weights by repetition rates.

A target that stops at a multiple of its source's size, with the excess shared out again by
weight, is a water level: target = least(cap, level * weight).  The level is found on the
table of sources by a few scalar aggregates, so neither documents nor sources meet in one
task.  Each document is then taken floor(rate) times, plus once more if the hash of its id,
seen as a number from 0 to 1, lies below the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrail.llm.common import WORD, staged, whole_text, with_positions

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all sizes
MOST = 2  # times a source's size
SEED = "mix-1"
HEX_DIGITS = 13  # 52 bits of the hash, exact in a double


def text_size(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """`source`, `source_size`, `target` and `rate` of every source of `sized` (source, size).

    Sources take the weights in turn, by code point, null last.  A source without words has
    the target 0.  The null source is a source like any other.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_positions(totals, [F.col("source").asc_nulls_last()], "mix-sources")
    turn = (F.col("_position") % len(weights)).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    sources = staged(
        ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most), "mix-weights"
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        held, open_weight, n = sources.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0)),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.count_if(full),
        ).first()
        if n == capped or not open_weight:
            break
        level, capped = (share * total - held) / open_weight, n
    target = F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return sources.withColumn("target", target).select("source", "source_size", "target").withColumn("rate", rate)


def _rated(docs: DataFrame, seed: str, **options) -> DataFrame:
    """Every row with `_size`, `_source_size`, `_target` and `_copies`."""
    sized = docs.withColumn("_size", text_size())
    targets = source_targets(sized.select("source", F.col("_size").alias("size")), **options)
    # equality on never-null columns: a null source joins like any other
    keyed = targets.select(
        F.coalesce("source", F.lit("")).alias("_source"), F.isnull("source").alias("_none"),
        F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate"),
    )
    joined = (
        sized.withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_none", F.isnull("source"))
        .join(keyed, ["_source", "_none"], "left")
    )
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    draw = F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") / float(16**HEX_DIGITS)
    whole = F.floor("_rate")
    return joined.withColumn("_copies", whole + (draw < F.col("_rate") - whole).cast("long"))


def copies(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """Every row of `docs` with `size`, `source_size`, `target` and `n_copies`.

    Null texts have the size 0.  Rows that share a doc_id share their draw, null ids too, so
    reruns agree; only doc_id, text and source are read, other columns pass through (one
    that carries a new column's name is replaced).
    """
    new = {"size": "_size", "source_size": "_source_size", "target": "_target", "n_copies": "_copies"}
    return _rated(docs, seed, **options).select(
        *(f"`{c}`" for c in docs.columns if c not in new), *(F.col(v).alias(k) for k, v in new.items())
    )


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The documents of the mix: each row as often as it is taken, with the columns of `docs`."""
    taken = _rated(docs, seed, **options).where(F.col("_copies") > 0)
    repeated = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*(f"`{c}`" for c in docs.columns))


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS turn
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, {MOST} * source_size AS cap FROM totals
), steps AS (
  SELECT *, sum(cap) OVER w AS held, sum(weight) OVER () - sum(weight) OVER w AS open_weight
  FROM weighted WINDOW w AS (ORDER BY cap / weight RANGE UNBOUNDED PRECEDING)
), levels AS (
  SELECT 0 AS held, sum(weight) AS open_weight, 0 AS reached FROM weighted
  UNION ALL SELECT held, open_weight, cap / weight FROM steps WHERE open_weight > 0
), level AS (
  SELECT max(CASE WHEN l >= reached THEN l END) AS level FROM (
    SELECT reached, ({SHARE} * (SELECT sum(source_size) FROM weighted)::DOUBLE - held) / open_weight AS l FROM levels)
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target FROM weighted, level
), rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5(concat_ws(':', '{SEED}', doc_id::VARCHAR)), 1, {HEX_DIGITS}))::BIGINT::DOUBLE / {float(16**HEX_DIGITS)!r} AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
