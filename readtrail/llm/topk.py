"""Exact top-k search by columnar branch and bound.

Vectors are packed into blocks that lie dimension by dimension.  Scores build up one group of
dimensions after the other, largest query components first; after a group the rest of a
score lies within the product of the remaining norms of query and candidate, candidates
whose upper bound is below the k-th lower bound go, and the others are compacted.  Queries
and candidates meet block by block: the first groups are summed for all queries of a block
together, as a product of matrices, until few candidates are left to each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readtrail.llm.common import map_rows, shuffle_partitions, staged

SCALE = 256
K = 5
QUERY_STEP = 50
GROUP = 8  # dimensions summed between two prunings
BLOCK_ROWS = 8_192  # candidates in a block
QUERY_ROWS = 256
FEW = 1 / 32  # of a block's candidates left to a query, from which on it goes on by itself
EXACT = 2.0**53


def scaled_vectors(vectors: DataFrame, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """`vec_id` and `_v`, the vector as floor(scale * x) of each component as a double.

    Vectors that are null, empty or hold a null or non-finite component take no part, nor
    do rows without an id.
    """
    usable = F.col("vec_id").isNotNull() & (F.size(vector) > 0) & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    )
    value = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(usable).select("vec_id", value.alias("_v"))


def _blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Packed blocks (width, block, n, ids, values) of vectors of one width."""

    def pack(batches) -> Iterator[tuple]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = vector.values.to_numpy()
                ids, found = held.setdefault(len(values), ([], []))
                ids.append(vec_id)
                found.append(values)
                if len(ids) == rows:
                    yield _packed(len(values), *held.pop(len(values)))
        for width, some in held.items():
            yield _packed(width, *some)

    return staged(map_rows(vectors, pack, "width int, n int, octets int, ids binary, data binary", flush=4), name)


def _packed(width: int, ids: list[int], vectors: list[np.ndarray]) -> tuple:
    data = np.stack(vectors, axis=1).astype(np.int64)  # width rows, one column a vector
    low, high = data.min(initial=0), data.max(initial=0)
    kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return width, len(ids), np.dtype(kind).itemsize, np.array(ids, np.int64).tobytes(), data.astype(kind).tobytes()


def _columns(data: bytes, octets: int, n: int) -> np.ndarray:
    return np.frombuffer(data, f"i{octets}").reshape(-1, n).astype(np.int64)


class Candidates:
    """A block of candidates, vertical, with the norm of what remains after each group."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, columns = ids[order], columns[:, order]
        size = np.abs(columns).max(initial=0)
        self.exact = size < 2**26
        self.columns = columns.astype(np.float64) if self.exact else columns
        self.largest = float(size)
        self.squares = np.square(columns.astype(np.float64))
        self.mass = self.squares.sum(axis=0)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, ties to smaller ids, the query's own id left out."""
        n = len(self.ids)
        # sums that a double may not hold are taken in integers, and nothing is pruned by them
        exact = self.exact and float(np.abs(query).astype(np.float64).sum()) * self.largest < EXACT
        columns = self.columns if exact else self.columns.astype(np.int64)
        order = np.argsort(-np.abs(query.astype(np.float64)), kind="stable")
        q = query.astype(columns.dtype)
        return self._finish(q, order, 0, own, k, np.arange(n), np.zeros(n, columns.dtype), self.mass, exact, columns)

    def _finish(
        self, q: np.ndarray, order: np.ndarray, lo: int, own: int, k: int, live: np.ndarray, scores: np.ndarray,
        mass: np.ndarray, exact: bool, columns: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Go on from dimension `lo` of the order with the candidates that are left."""
        rest_q = _rest(np.square(q[order].astype(np.float64)))
        for lo in range(lo, len(order), GROUP):
            dims = order[lo:lo + GROUP]
            hi = lo + len(dims)
            part = slice(None) if len(live) == len(self.ids) else live
            scores = scores + q[dims] @ columns[dims][:, part]
            if exact and hi < len(order) and len(live) > k:
                mass = np.maximum(mass - self.squares[dims][:, part].sum(axis=0), 0.0)
                slack = rest_q[hi] * np.sqrt(mass) * (1 + 1e-9) + 1e-3
                lower = scores - slack
                lower[self.ids[live] == own] = -np.inf
                keep = scores + slack >= np.partition(lower, len(live) - k)[len(live) - k]
                live, scores, mass = live[keep], scores[keep], mass[keep]
        other = self.ids[live] != own
        live, scores = live[other], scores[other]
        top = np.lexsort((live, -scores))[:k]  # ids ascend with their place
        return self.ids[live[top]], scores[top].astype(np.int64)

    def best_of_all(self, queries: np.ndarray, owns: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query (a column of `queries`) its own id, and what :meth:`best` gives."""
        sums = np.abs(queries).astype(np.float64).sum(axis=0)
        together = np.flatnonzero((sums * self.largest < EXACT) & self.exact) if len(self.ids) > 16 * k else np.zeros(0, np.int64)
        for i in np.setdiff1d(np.arange(len(owns)), together).tolist():
            yield int(owns[i]), *self.best(queries[:, i], int(owns[i]), k)
        if not len(together):
            return
        n, q = len(self.ids), queries[:, together].T.astype(np.float64)
        owns = owns[together]
        mine_lo, mine_hi = np.searchsorted(self.ids, owns), np.searchsorted(self.ids, owns, "right")
        order = np.argsort(-np.square(q).sum(axis=0), kind="stable")  # one order for the block
        rest_q = _rest(np.square(q[:, order]))
        scores, mass = np.zeros((len(q), n)), self.mass
        keep = np.ones((len(q), n), bool)
        hi = 0
        for lo in range(0, len(order), GROUP):
            dims = order[lo:lo + GROUP]
            hi = lo + len(dims)
            scores += q[:, dims] @ self.columns[dims]
            mass = np.maximum(mass - self.squares[dims].sum(axis=0), 0.0)
            if hi == len(order) or (lo // GROUP) % 2:
                slack = rest_q[:, hi, None] * np.sqrt(mass) * (1 + 1e-9) + 1e-3
                lower = scores - slack
                for i, (a, b) in enumerate(zip(mine_lo.tolist(), mine_hi.tolist())):
                    lower[i, a:b] = -np.inf
                least = np.partition(lower, n - k, axis=1)[:, n - k]
                keep = scores + slack >= least[:, None]
                if keep.sum() <= FEW * keep.size:
                    break
        for i, own in enumerate(owns.tolist()):
            live = np.flatnonzero(keep[i])
            yield own, *self._finish(q[i], order, hi, own, k, live, scores[i, live], mass[live], True, self.columns)


def _rest(squares: np.ndarray) -> np.ndarray:
    """Norms of what remains from each dimension on, and 0 behind the last."""
    total = np.cumsum(squares[..., ::-1], axis=-1)[..., ::-1]
    return np.sqrt(np.concatenate((total, np.zeros((*squares.shape[:-1], 1))), axis=-1))


def search(vectors: DataFrame, is_query: Column | None = None, k: int = K, scale: int = SCALE) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the k best inner products of every query vector.

    Queries are the rows for which `is_query` holds (by default ids divisible by
    QUERY_STEP); candidates are all rows with another id and a vector as long as the
    query's.  Rows that repeat an id stay candidates each; a repeated query id answers for
    its largest vector.  An empty table gives no rows.
    """
    is_query = F.col("vec_id") % QUERY_STEP == 0 if is_query is None else is_query
    usable = scaled_vectors(vectors, scale)
    candidates = _blocks(usable, BLOCK_ROWS, "topk-candidates")
    one_each = usable.where(is_query).groupBy("vec_id").agg(F.max("_v").alias("_v"))
    asked = _blocks(one_each, QUERY_ROWS, "topk-queries")
    # candidate blocks are spread over as many keys as there are tasks; every key gets the query blocks
    slots = max(1, min(shuffle_partitions(vectors.sparkSession), candidates.count()))
    spread = candidates.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"))
    each = asked.select(
        "width", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"),
        *[F.col(c).alias(f"q_{c}") for c in ("n", "octets", "ids", "data")],
    )
    pairs = spread.join(each, ["width", "slot"])  # blocks of one width, each pair once

    def rows(batches) -> Iterator[tuple]:
        last, block = None, None
        for batch in batches:
            for n, octets, ids, data, q_n, q_octets, q_ids, q_data in zip(*(c.to_pylist() for c in batch.columns)):
                if ids != last or block is None or block.columns.shape[0] * n * octets != len(data):
                    last, block = ids, Candidates(np.frombuffer(ids, np.int64), _columns(data, octets, n))
                queries = _columns(q_data, q_octets, q_n)
                for own, found, scores in block.best_of_all(queries, np.frombuffer(q_ids, np.int64), k):
                    for vec_id, score in zip(found.tolist(), scores.tolist()):
                        yield own, vec_id, score

    found = map_rows(
        pairs.select("n", "octets", "ids", "data", "q_n", "q_octets", "q_ids", "q_data"), rows, "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


ORACLE_SQL = f"""
WITH finite AS (
  SELECT vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM finite q JOIN finite c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % {QUERY_STEP} = 0
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= {K}
"""
