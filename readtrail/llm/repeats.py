"""Suffix-array removal of repeated byte strings.

A byte goes if a string of 100 bytes that covers it starts earlier too.  Sorting the suffixes
at every byte of a corpus would move it a hundred times over, so suffixes are sorted at
anchors only (`anchors.py`): equal windows have equal anchors.

1. Each task finds the anchors of its texts.  Anchors that agree in their whole context (as
   far as a window around them reaches) are repeats but for the earliest; a task sends on
   only its earliest of each context, and one entry for a gram that has several contexts.
2. Per gram hash the earliest of each context remains.  Grams with several contexts ask for
   the bytes around them.
3. Those contexts are sorted, forward from the anchor and backward from it, by deep-shallow
   sorting.  From both orders and their common prefixes follows how far each context
   agrees with earlier ones in any way that makes up a window.
4. A gram with very many contexts (a common line) is not put in one task: its windows are
   compared one by one, combined before they are shuffled.
5. The intervals of a document are united and cut from its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readtrail.llm import anchors as A
from readtrail.llm.common import map_rows, shuffle_partitions, staged, temporary_tables, whole_text, with_positions
from readtrail.llm.suffix_sort import SYMBOL, deep_shallow_sort

BUCKET_BYTES = 128 << 20  # of text whose anchors meet in a task
FLUSH_ANCHORS = 1 << 19
HOT_CONTEXTS = 20_000  # contexts of one gram beyond which its windows are compared instead
CUT, ASK, CONTEXT = 0, 1, 2  # kinds of rows
MARKS = "kind int, row long, low int, high int, place int, gram long, data binary"
_ENTRY = [("gram", "<u8"), ("context", "<u8"), ("row", "<i8"), ("place", "<i4"), ("low", "u1"), ("high", "u1"), ("several", "u1")]


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Marks of the first of each run of equal keys."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return new


def united(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching intervals joined, in order."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    return low[new], high[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)]


def _cuts(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple]:
    """United intervals of each row, as plain values."""
    out = []
    order = np.argsort(row, kind="stable")
    row, low, high = row[order], low[order], high[order]
    starts = np.flatnonzero(_runs(row))
    for lo, hi in zip(starts, np.append(starts[1:], len(row))):
        for a, b in zip(*united(low[lo:hi], high[lo:hi])):
            out.append((int(row[lo]), int(a), int(b)))
    return out


def _scan(buckets: int):
    """Rows (bucket, kind, row, low, high, place, gram, data) of a task's texts."""

    def combined(found: list[A.Found]) -> Iterator[tuple]:
        gram, context, row, place, low, high = (
            np.concatenate([getattr(f, k) for f in found]) for k in ("gram", "context", "row", "place", "low", "high")
        )
        which = np.repeat(np.arange(len(found), dtype=np.int32), [len(f.gram) for f in found])
        within = np.concatenate([np.arange(len(f.gram), dtype=np.int32) for f in found])
        order = np.lexsort((place, row, context, gram))
        gram, context, row, place, low, high = (x[order] for x in (gram, context, row, place, low, high))
        new_gram = _runs(gram)
        first = new_gram | _runs(context)
        # later than the earliest of its context: a repeat (the same place is met twice where segments overlap)
        leader = np.maximum.accumulate(np.where(first, np.arange(len(gram)), 0))
        later = (row != row[leader]) | (place != place[leader])
        for doc, a, b in _cuts(row[later], low[later], high[later]):
            yield doc % buckets, CUT, doc, a, b, None, None, None
        group = np.cumsum(new_gram) - 1
        several = (np.bincount(group[first]) > 1)[group]
        for i in np.flatnonzero(first & several):
            k = order[i]
            around = found[which[k]].bytes_around(int(within[k]))
            yield int(gram[i] % np.uint64(buckets)), CONTEXT, int(row[i]), int(low[i]), int(high[i]), int(place[i]), int(gram[i].view(np.int64)), around
        send = np.where(several, new_gram, first)
        entry = np.zeros(int(send.sum()), _ENTRY)
        for name, values in (("gram", gram), ("context", context), ("row", row), ("place", place), ("several", several)):
            entry[name] = values[send]
        entry["low"], entry["high"] = (place - low)[send], (high - place)[send]
        bucket = (entry["gram"] % np.uint64(buckets)).astype(np.int64)
        turn = np.argsort(bucket, kind="stable")
        entry, bucket = entry[turn], bucket[turn]
        starts = np.flatnonzero(_runs(bucket))
        for lo, hi in zip(starts, np.append(starts[1:], len(bucket))):
            # field by field, each by byte place: zeros and near values lie together
            data = b"".join(entry[n][lo:hi].copy().view(np.uint8).reshape(hi - lo, -1).T.tobytes() for n in entry.dtype.names)
            yield int(bucket[lo]), ASK, int(hi - lo), None, None, None, None, data

    def rows(batches) -> Iterator[tuple]:
        def texts() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), (t.encode() for t in batch.column(1).to_pylist()))

        held: list[A.Found] = []
        n = 0
        for chunk in A.segments(texts()):
            held.append(A.anchors(*chunk))
            n += len(held[-1].gram)
            if n >= FLUSH_ANCHORS:
                yield from combined(held)
                held, n = [], 0
        if held:
            yield from combined(held)

    return rows


def _entries(data: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, _ENTRY)
    at = 0
    for name in out.dtype.names:
        size = out.dtype[name].itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out[name] = np.ascontiguousarray(planes.T).view(out.dtype[name]).ravel()
        at += n * size
    return out


def _arrow(kind, row, low, high, place, gram, data=None) -> pa.Table:
    n = len(row)
    return pa.table({
        "kind": pa.array(np.full(n, kind), pa.int32()), "row": pa.array(row, pa.int64()),
        "low": pa.array(low, pa.int32()), "high": pa.array(high, pa.int32()), "place": pa.array(place, pa.int32()),
        "gram": pa.array(gram, pa.int64()), "data": pa.array(data if data is not None else [None] * n, pa.binary()),
    })


def _reduce(asked: pa.Table) -> pa.Table:
    """Cuts, and questions for the bytes around grams with several contexts, of one bucket's entries."""
    parts = [_entries(d, n) for d, n in zip(asked["data"].to_pylist(), asked["row"].to_pylist())]
    entry = np.concatenate(parts)
    entry = entry[np.lexsort((entry["place"], entry["row"], entry["context"], entry["gram"]))]
    gram = entry["gram"]
    new_gram = _runs(gram)
    first = new_gram | _runs(entry["context"])
    group = np.cumsum(new_gram) - 1
    several = ((np.bincount(group[first]) > 1) | (np.bincount(group, entry["several"]) > 0))[group]
    leader = np.maximum.accumulate(np.where(first, np.arange(len(gram)), 0))
    later = (entry["row"] != entry["row"][leader]) | (entry["place"] != entry["place"][leader])
    place = entry["place"].astype(np.int64)
    low, high = place - entry["low"], place + entry["high"]
    # an entry marked `several` stands for contexts that its task has sent already
    ask = several & first & (entry["several"] == 0)
    cut = later & (entry["several"] == 0)
    return pa.concat_tables([
        _arrow(kind, entry["row"][at], low[at], high[at], place[at], gram[at].view(np.int64))
        for kind, at in ((CUT, cut), (ASK, ask))
    ])


def _padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8)
    return data.reshape(len(parts), width), sizes


def _reach(nodes: tuple[np.ndarray, np.ndarray], classes: tuple[np.ndarray, np.ndarray], age: np.ndarray) -> np.ndarray:
    """Per row the longest agreement on one side with an earlier row that fills a window on the other.

    Each side is (order, common prefix in it without the gram; -1 between grams).  Rows that
    agree on r bytes meet in a node of the first order's tree of depth r; there they agree on
    the other REACH - r bytes if they are in one run of the second order.  Nodes matter only
    at the depth at which they fork.  -1: no earlier row.
    """
    order, common = nodes
    other, other_common = classes
    n = len(order)
    place, other_place = np.empty(n, np.int64), np.empty(n, np.int64)
    place[order], other_place[other] = np.arange(n), np.arange(n)
    reach = np.full(n, -1, np.int64)
    for depth in range(A.REACH, -1, -1):
        forks = common == depth
        if not forks.any():
            continue
        node = np.cumsum(common < depth)
        node -= node[0]
        forked = np.zeros(node[-1] + 1, bool)
        forked[node[forks]] = True
        rows = order[forked[node]]
        run = np.cumsum(other_common < A.REACH - depth)
        key = node[place[rows]] * (n + 1) + run[other_place[rows]]
        turn = np.lexsort((age[rows], key))
        rows, key = rows[turn], key[turn]
        first = np.maximum.accumulate(np.where(_runs(key), np.arange(len(rows)), 0))
        later = rows[age[rows] > age[rows[first]]]
        reach[later[reach[later] < 0]] = depth
    return reach


def agreements(rows: np.ndarray, places: np.ndarray, before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How far each context agrees with earlier ones, before its anchor and past its gram.

    `before` holds up to REACH bytes ahead of the anchor, `after` up to WINDOW bytes from it.
    Only earlier contexts count whose agreement holds a whole window; -1 where none does.
    """
    seen = np.lexsort((places, rows))
    new = _runs(rows[seen]) | _runs(places[seen])
    age = np.empty(len(rows), np.int64)
    age[seen] = np.cumsum(new)  # a place met in two overlapping segments has one age
    forward, sizes = _padded(after, A.WINDOW)
    order, common = deep_shallow_sort(forward, sizes, A.GRAM // SYMBOL + 2)
    gram = np.empty(len(rows), ">u8")
    gram[order] = np.cumsum(common < A.GRAM)
    backward, sizes = _padded([b[::-1] for b in before], A.REACH)
    keyed = np.concatenate([gram.view(np.uint8).reshape(-1, SYMBOL), backward], axis=1)
    back_order, back_common = deep_shallow_sort(keyed, sizes + SYMBOL, 3)
    sides = (order, np.maximum(common - A.GRAM, -1)), (back_order, np.maximum(back_common - SYMBOL, -1))
    # between grams the common prefix is cut: a key that differs agrees on less than a symbol
    ahead, back = _reach(sides[0], sides[1], age), _reach(sides[1], sides[0], age)
    return back, ahead


def _compare(table: pa.Table) -> pa.Table:
    """Cuts of one bucket of contexts."""
    row, low, place = (table[k].to_numpy() for k in ("row", "low", "place"))
    place = place.astype(np.int64)
    data = table["data"].to_pylist()
    split = [int(p - a) for p, a in zip(place, low)]
    back, ahead = agreements(row, place, [d[:s] for d, s in zip(data, split)], [d[s:] for d, s in zip(data, split)])
    at = ahead >= 0
    cuts = _cuts(row[at], (place - back)[at], (place + A.GRAM + ahead)[at])
    return pa.table({
        "row": pa.array([c[0] for c in cuts], pa.int64()), "low": pa.array([c[1] for c in cuts], pa.int32()),
        "high": pa.array([c[2] for c in cuts], pa.int32()),
    })


def _window_rows(batches) -> Iterator[tuple]:
    for batch in batches:
        for row, low, data in zip(*(c.to_pylist() for c in batch.columns)):
            for k in range(len(data) - A.WINDOW + 1):
                yield xxhash.xxh3_128_digest(data[k:k + A.WINDOW]), row, low + k


def _hot_cuts(contexts: DataFrame) -> DataFrame:
    """Cuts by comparing window with window: equal windows but the earliest go."""
    windows = map_rows(contexts.select("row", "low", "data"), _window_rows, "window binary, row long, low int", flush=1 << 15)
    earliest = windows.groupBy("window").agg(F.min(F.struct("row", "low")).alias("first"))
    return windows.join(earliest, "window").where(F.struct("row", "low") > F.col("first")).select(
        "row", "low", (F.col("low") + A.WINDOW).alias("high")
    )


def numbered(docs: DataFrame) -> DataFrame:
    """Documents with `_row`, a unique number in the order of doc_id.

    Where ids are null or repeat, documents are numbered by (id, null last; hash of the
    text), so rows that share an id count as documents one after the other.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    odd = ids.where(F.col("doc_id").isNull() | (F.col("n") > 1)).limit(1)
    if odd.isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), F.col("text").asc_nulls_first()]
    return with_positions(docs, order, "repeat-ids").withColumnRenamed("_position", "_row")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """`row`, `low`, `high`: intervals to cut from `rows` (_row, text), overlaps not yet united."""
    rows = rows.select("_row", "text")
    n = shuffle_partitions(rows.sparkSession)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(n, -(-total // BUCKET_BYTES))
    scanned = map_rows(rows.select("_row", "text"), _scan(buckets), f"bucket long, {MARKS}")
    # only packed entries are grouped: a common line has few of those, but a context in every task
    scanned = staged(scanned, "repeat-scan")
    passed = scanned.where(F.col("kind") != ASK).drop("bucket")
    asking = scanned.where(F.col("kind") == ASK).groupBy("bucket").applyInArrow(_reduce, MARKS)
    marks = passed.unionByName(staged(asking, "repeat-marks"))
    asked = (
        marks.where(F.col("kind") == ASK).groupBy("row")
        .agg(F.collect_list(F.struct("low", "high", "place", "gram")).alias("asks"))
    )

    def answers(batches) -> Iterator[tuple]:
        for batch in batches:
            for row, text, asks in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                for a in asks:
                    yield row, a["low"], a["place"], a["gram"], data[a["low"]:a["high"]]

    schema = "row long, low int, place int, gram long, data binary"
    texts = rows.join(asked, F.col("_row") == F.col("row")).select("row", "text", "asks")
    given = marks.where(F.col("kind") == CONTEXT).select("row", "low", "place", "gram", "data")
    contexts = staged(given.unionByName(map_rows(texts, answers, schema)), "repeat-contexts")
    hot = contexts.groupBy("gram").count().where(F.col("count") > HOT_CONTEXTS).select("gram")
    cold = contexts.join(hot, "gram", "left_anti").withColumn("bucket", F.pmod("gram", F.lit(buckets)))
    compared = cold.groupBy("bucket").applyInArrow(_compare, "row long, low int, high int")
    cuts = marks.where(F.col("kind") == CUT).select("row", "low", "high").unionByName(compared)
    if hot.isEmpty():
        return cuts
    return cuts.unionByName(_hot_cuts(contexts.join(hot, "gram", "left_semi")))


def _cut(text: str, spans: list | None) -> tuple[list[tuple[int, int]], bytes]:
    data = text.encode()
    if not spans:
        return [], data
    low, high = united(*(np.array(x, np.int64) for x in zip(*((s["low"], s["high"]) for s in spans))))
    kept, at = [], 0
    for a, b in zip(low.tolist(), high.tolist()):
        kept.append(data[at:a])
        at = b
    return list(zip(low.tolist(), high.tolist())), b"".join([*kept, data[at:]])


def map_cut(
    docs: DataFrame, keep: tuple[str, ...], emit: Callable[[str, bytes, list[tuple[int, int]]], tuple], schema: str
) -> DataFrame:
    """The kept columns and what `emit(text, remaining bytes, removed spans)` gives for each document."""
    new = {f.name for f in StructType.fromDDL(schema)}
    keep = tuple(c for c in keep if c not in new)
    rows = numbered(docs.withColumn("text", whole_text()).select(*dict.fromkeys([*keep, "doc_id", "text"])))
    with temporary_tables(docs.sparkSession) as kept:
        spans = repeated_spans(rows).groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("_spans"))
        spans = kept(spans, "repeat-spans")
    joined = rows.join(spans.withColumnRenamed("row", "_span_row"), F.col("_row") == F.col("_span_row"), "left")
    types = dict(rows.dtypes)

    def out(batches) -> Iterator[tuple]:
        for batch in batches:
            *others, texts, found = (c.to_pylist() for c in batch.columns)
            for i, text in enumerate(texts):
                cut, rest = _cut(text, found[i])
                yield (*(o[i] for o in others), *emit(text, rest, cut))

    columns = [F.col(f"`{c}`") for c in keep]
    first = "".join(f"`{c}` {types[c]}, " for c in keep)
    return map_rows(joined.select(*columns, F.col("text").alias("_text"), "_spans"), out, first + schema)


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, the removed `spans` (low, high; in bytes) and `kept`, the remaining bytes.

    Null and empty texts have no bytes; texts of under 100 bytes keep all of theirs.
    """

    def emit(text: str, rest: bytes, cut: list[tuple[int, int]]) -> tuple:
        return [{"low": a, "high": b} for a, b in cut], rest

    return map_cut(docs, keep, emit, "spans array<struct<low: long, high: long>>, kept binary")


def removal_digests(docs: DataFrame) -> DataFrame:
    def emit(text: str, rest: bytes, cut: list[tuple[int, int]]) -> tuple:
        size = len(text.encode())
        return size, size - len(rest), len(cut), hashlib.sha256(rest).hexdigest()

    return map_cut(docs, ("doc_id",), emit, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Documents with their remaining texts (and `n_chars`, if there is such a column).

    A cut may fall within a character; bytes left of one are dropped.  Documents of which
    nothing is left go, those that were empty before stay.
    """
    counted = "n_chars" in docs.columns

    def emit(text: str, rest: bytes, cut: list[tuple[int, int]]) -> tuple:
        left = rest.decode(errors="ignore") if cut else text
        return (left, not cut or bool(left.strip())) + ((len(left),) if counted else ())

    schema = "text string, _stays boolean" + (", n_chars long" if counted else "")
    return map_cut(docs, tuple(docs.columns), emit, schema).where("_stays").select(*(f"`{c}`" for c in docs.columns))
