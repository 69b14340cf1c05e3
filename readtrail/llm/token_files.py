"""Token files: ids in document order, compressed by Re-Pair per shard.

Re-Pair replaces frequent pairs of adjacent symbols by new symbols, again and again; a file
holds the rules, the length each rule expands to, where each document begins, and what is
left of the sequence.  Pairs never span two documents, so one document is read by expanding
its own symbols only.  A round replaces all pairs that are frequent at that moment; a rule
uses symbols of earlier rounds only, so expansion runs over the rounds backwards.

File layout (little-endian): magic `RPT1`; uint32 base, n_rules, n_symbols, n_docs,
n_rounds, symbol bytes; uint32 first symbol of each round; uint32 left and right symbol and
expansion length of each rule; int64 document ids; uint8 null marks; uint32 first symbol
(n_docs + 1) and number of ids of each document; the symbols.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readtrail.llm.common import Memo, map_rows, per_worker, shuffle_partitions, whole_text

END_ID = 1
SHARD_IDS = 1 << 20
ROUNDS = 4
LEAST_COUNT = 16  # occurrences that make a pair worth a rule
SLOTS_BITS = 18
PARTS_KEPT = 1_200_000
MAGIC = b"RPT1"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
# white space for every rule of the model, so nothing is merged or composed across it
BLANKS = "\t\n\v\f\r"
_plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%&$*#|]*)")


class WordCoder:
    """Ids by a `tokenizers` file; parts between blanks are memorised.

    A part of plain letters and then plain marks is to the model's rules a word, whatever its
    case, and its marks, so such words go to its merges directly; in lower case and without
    marks they are parts like others.
    """

    def __init__(self, model_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = Tokenizer.from_file(model_file)
        self.merges = self.model.model
        self.base = self.model.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if self.base <= 1 << 16 else np.dtype("<u4")
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()]
        self.letters = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})
        self.parts = Memo(self._part, PARTS_KEPT)

    def _word(self, word: str) -> bytes:
        symbols = word if word.isascii() else word.translate(self.letters)
        return array(self.kind.char, [t.id for t in self.merges.tokenize(symbols)]).tobytes()

    def _part(self, part: str) -> bytes:
        m = _plain.fullmatch(part)
        if m:
            word, marks = m[1].lower(), m[2]
            if marks:
                return self.parts[word] + self.parts[marks]
            return self._word(part) if word == part else self.parts[word]
        return array(self.kind.char, self.model.encode(part, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        for blank in BLANKS:
            if blank in text:
                text = text.replace(blank, " ")
        return np.frombuffer(b"".join(map(self.parts.__getitem__, text.split(" "))), self.kind)


def compress(ids: np.ndarray, last: np.ndarray, base: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[int]]:
    """Symbols, their end-of-document marks, the rules' (left, right), first symbol of each round.

    Symbols stay below `most` (default: what two bytes hold, if the base vocabulary fits them).
    """
    most = most or (1 << 16 if base <= 1 << 16 else 1 << 32)
    seq, last = ids.astype(np.uint32), last.copy()
    rules: list[np.ndarray] = []
    rounds: list[int] = []
    symbol = base
    for left in range(ROUNDS, 0, -1):
        room = (most - symbol) // left
        if len(seq) < 2 or room < 1:
            break
        pair = seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]
        slot = (pair * _SPREAD >> np.uint64(64 - SLOTS_BITS)).astype(np.intp)
        held = np.zeros(1 << SLOTS_BITS, np.uint64)
        held[slot] = pair  # pairs that meet in a slot: one of them has it this round
        own = (held[slot] == pair) & ~last[:-1]
        counts = np.bincount(slot[own], minlength=1 << SLOTS_BITS)
        chosen = np.flatnonzero(counts >= LEAST_COUNT)
        if len(chosen) > room:
            chosen = chosen[np.argpartition(counts[chosen], -room)[-room:]]
        if not len(chosen):
            break
        rule_of = np.full(1 << SLOTS_BITS, -1, np.int64)
        rule_of[chosen] = np.arange(len(chosen))
        at = np.flatnonzero(own & (rule_of[slot] >= 0))
        start = np.concatenate(([True], np.diff(at) != 1))  # of a run of overlapping pairs
        nth = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        at = at[nth % 2 == 0]
        used = np.unique(rule_of[slot[at]])
        number = np.zeros(len(chosen), np.uint32)
        number[used] = symbol + np.arange(len(used), dtype=np.uint32)
        rules.append(held[chosen[used]])
        rounds.append(symbol)
        symbol += len(used)
        seq[at] = number[rule_of[slot[at]]]
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
    return seq, last, rules, rounds


def write_file(doc_ids: list[int | None], docs: list[np.ndarray], base: int) -> bytes:
    sizes = np.array([len(d) for d in docs], "<u4")
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes, dtype=np.int64)[sizes > 0] - 1] = True
    seq, last, pairs, rounds = compress(ids, last, base)
    pair = np.concatenate(pairs) if pairs else np.zeros(0, np.uint64)
    left, right = (pair >> np.uint64(32)).astype("<u4"), pair.astype("<u4")
    length = np.ones(base + len(pair), "<u4")
    for first, rules in zip(rounds, pairs):
        to = slice(first, first + len(rules))
        of = slice(first - base, first - base + len(rules))
        length[to] = length[left[of]] + length[right[of]]
    starts = np.zeros(len(docs) + 1, "<u4")
    ends = np.flatnonzero(last) + 1
    starts[1:] = np.concatenate(([0], ends))[np.cumsum(sizes > 0)]
    kind = "<u2" if base + len(pair) <= 1 << 16 else "<u4"
    head = struct.pack("<6I", base, len(pair), len(seq), len(docs), len(rounds), np.dtype(kind).itemsize)
    return b"".join([
        MAGIC, head, np.array(rounds, "<u4").tobytes(), left.tobytes(), right.tobytes(),
        length[base:].tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(), starts.tobytes(), sizes.tobytes(),
        seq.astype(kind).tobytes(),
    ])


class TokenFile:
    """A written shard; `document(k)` expands the symbols of one document only."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.base, rules, symbols, docs, rounds, wide = struct.unpack_from("<6I", data, 4)
        at = 28

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rounds = take("<u4", rounds)
        self.left, self.right, self.length = (take("<u4", rules) for _ in range(3))
        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else int(i) for i, n in zip(ids, null)]
        self.starts, self.sizes = take("<u4", docs + 1), take("<u4", docs)
        self.symbols = take(f"<u{wide}", symbols)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        seq = symbols.astype(np.uint32)
        for first in self.rounds[::-1]:
            at = seq >= first
            to = np.cumsum(at) + np.arange(len(seq))  # where each symbol's last part goes
            rule = seq[at] - self.base
            out = np.empty(len(seq) + len(rule), np.uint32)
            out[to[~at]] = seq[~at]
            out[to[at] - 1], out[to[at]] = self.left[rule], self.right[rule]
            seq = out
        return seq

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.starts[k]:self.starts[k + 1]])

    def documents(self) -> Iterator[np.ndarray]:
        ids = self.expand(self.symbols)
        ends = np.cumsum(self.sizes, dtype=np.int64)
        return (ids[e - n:e] for e, n in zip(ends, self.sizes))


def write_token_files(docs: DataFrame, path: str, model_file: str, end_id: int = END_ID) -> None:
    """One row (part, shard, n_docs, n_ids, file) per token file, as Parquet under `path`.

    Documents go in ascending doc_id order over parts and shards; null ids first, documents
    that share an id in the order of a hash of their texts.  Null and empty texts hold the
    end id only.
    """
    source = docs.select("doc_id", whole_text().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = source.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)

    def rows(batches) -> Iterator[tuple]:
        coder = per_worker(("words", model_file), lambda: WordCoder(model_file))
        end = np.array([end_id], coder.kind)
        part, shard, n = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []

        def filed() -> tuple:
            return part, shard, len(names), n, write_file(names, held, coder.base)

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(np.append(coder.encode(text), end))
                names.append(doc)
                n += len(held[-1])
                if n >= SHARD_IDS:
                    yield filed()
                    held, names, n, shard = [], [], 0, shard + 1
        if names:
            yield filed()

    schema = "part int, shard int, n_docs long, n_ids long, file binary"
    map_rows(ordered, rows, schema, flush=4).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id`, `start`, `n_tokens` and `ids_crc32` of every document in the files."""
    files = spark.read.parquet(path)

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            for part, shard, data in zip(*(c.to_pylist() for c in batch.columns)):
                file, before = TokenFile(data), 0
                for doc, ids in zip(file.doc_ids, file.documents()):
                    yield part, shard, doc, before, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))
                    before += len(ids)

    schema = "part int, shard int, doc_id long, _in_shard long, n_tokens long, ids_crc32 long"
    read = map_rows(files.select("part", "shard", "file"), rows, schema)
    # ids before a shard: before its part (one row a part meets in a task), and within it
    in_part = Window.partitionBy("part").orderBy("shard")
    shards = files.select("part", "shard", (F.sum("n_ids").over(in_part) - F.col("n_ids")).alias("_in_part"))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_ids")).select(
        "part", (F.sum("_ids").over(Window.orderBy("part")) - F.col("_ids")).alias("_before")
    )
    start = F.col("_before") + F.col("_in_part") + F.col("_in_shard")
    return read.join(shards, ["part", "shard"]).join(parts, "part").select(
        "doc_id", start.alias("start"), "n_tokens", "ids_crc32"
    )
