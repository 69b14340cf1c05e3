"""Helpers shared by the operators: texts, staged tables, worker memos, running positions."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from readtrail.session import remove_folder, scratch_folder

# a word: a run of anything but the space, tab, line feed, vertical tab, form feed, return
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 8 << 20
LONGEST_KEY = 64
MOST_BITS = 1 << 26  # of a table of bits that every executor gets: 8 MB

Rows = Iterator[pa.RecordBatch]


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged inside are removed at the end, but for what goes through the given function."""
    own: list[str] = []
    token = _tables.set(own)

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        own.pop()
        return out

    try:
        yield kept
    finally:
        _tables.reset(token)
        for path in own:
            remove_folder(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_folder(df.sparkSession, name)
    if (tables := _tables.get()) is not None:
        tables.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def perhaps_among(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of `df` whose `column` is in `ids` and a few others; `df` is not shuffled.

    `ids` has long ids in the same column and is read twice.  Its hashes are marked in a table
    of 16 to 32 bits an id, MOST_BITS at most, that is sent to the rows; beyond that, more of
    the other rows pass.  Null is among no ids.
    """
    slots = min(MOST_BITS, 1 << max(15, (16 * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64(column), F.lit(slots))
    page, place = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    pages = ids.groupBy(page.alias("_page")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = byte.bitwiseAND(F.expr("shiftleft(1, int(_place % 8))")) != 0
    asked = df.where(F.col(column).isNotNull()).withColumns({"_page": page, "_place": place})
    return asked.join(F.broadcast(pages), "_page").where(marked).select(*df.columns)


def bounded_batches(df: DataFrame) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def map_rows(df: DataFrame, rows: Callable[[Rows], Iterable[tuple]], schema: str, flush: int = 2048) -> DataFrame:
    """mapInArrow for a function from record batches to tuples.

    Batches are bounded by bytes, so a run of very long texts does not fill a worker.
    """
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Rows) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in rows(batches):
            held.append(row)
            size += sum(len(v) if isinstance(v, (str, bytes)) else v.nbytes for v in row if isinstance(v, (str, bytes, np.ndarray)))
            if len(held) >= flush or size >= BATCH_BYTES:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return bounded_batches(df).mapInArrow(run, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type, from_pandas=False) for c, f in zip(columns, schema)], schema=schema
    )


class Memo(dict):
    """Bounded memory of `compute(key)`: when full, the younger half of the keys stays.

    Texts of over LONGEST_KEY characters are computed each time.
    """

    def __init__(self, compute: Callable[[Any], Any], limit: int) -> None:
        super().__init__()
        self.compute, self.limit, self.older = compute, limit // 2, {}

    def __missing__(self, key: Any) -> Any:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if isinstance(key, str) and len(key) > LONGEST_KEY:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


_per_worker: dict[Hashable, Any] = {}


def per_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """One object per Python worker, kept over its tasks (a vocabulary with its memos).

    An object of another kind makes room, so a pipeline's operators do not add up.
    """
    if key not in _per_worker:
        _per_worker.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()  # what earlier batches took
        _per_worker[key] = make()
    return _per_worker[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers over all bits (multiply and xor-shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `_position` (from 0) in the total order of `order`.

    Rows are range-partitioned and staged with their partition; only one count per
    partition meets in one task.
    """
    n = shuffle_partitions(df.sparkSession)
    parts = staged(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), name)
    before = (
        parts.groupBy("_part").agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows"))
        .drop("_rows")
    )
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        parts.withColumn("_rank", rank).join(before, "_part")
        .withColumn("_position", F.col("_before") + F.col("_rank") - 1)
        .drop("_part", "_rank", "_before")
    )
