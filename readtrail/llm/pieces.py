"""SentencePiece encoding and decoding by backtracking over longest matches.

A merge vocabulary encodes a text as the one sequence of pieces of which every adjacent
pair, merged again on its own, gives that pair.  So the encoder walks left to right,
takes the longest piece that an Aho-Corasick automaton finds at a position, checks it
against the piece before by re-merging the two, tries shorter pieces, and steps back where
none fits, marking the position as failed in a bit field so that it is tried once.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readtrail.llm.common import Memo, map_rows, per_worker, whole_text

SPACE = "▁"  # how the vocabulary writes a space
CHUNKS_KEPT = 400_000
PAIRS_KEPT = 200_000
NONE = -1  # no symbol


_first, _second = itemgetter(0), itemgetter(1)


class PieceTokenizer:
    """Encoder and decoder for a merge-type model with byte fallback and no text rewriting."""

    def __init__(self, model_file: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes: dict[int, int] = {}
        self.silent: set[int] = set()
        self.unknown = model.unk_id()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        matcher = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[i] = int(piece[1:-1], 16)
            elif model.is_control(i):
                self.silent.add(i)
            elif i != self.unknown and not model.is_unused(i):
                self.ids[piece] = i
                self.score[piece] = model.get_score(i)
                matcher.add_word(piece, i)
        matcher.make_automaton()
        self.matcher = matcher
        # symbols are piece ids, then characters: those outside the vocabulary stand for their bytes
        self.count = len(self.pieces)
        self.lengths = [len(p) for p in self.pieces]
        # the longest piece that a piece starts with; a character starts any
        self.shorter = [
            next((self._symbol(p[:n]) for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in self.ids), NONE)
            for p in self.pieces
        ]
        self.plain: list[str | None] = [
            None if i in self.bytes else "" if i in self.silent else " ⁇ " if i == self.unknown
            else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)
        ]
        self.names = [str(i) for i in range(len(self.pieces))]
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.fits = Memo(self._fits, PAIRS_KEPT)
        self.span = self.count + sys.maxunicode + 1
        self.chunks = Memo(self._chunk, CHUNKS_KEPT // 4)
        self.words = Memo(self._word, CHUNKS_KEPT)
        self.adjacent = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        # no piece reaches past a space or over a character that only stands alone: cut there
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        alone = "" if "\n" in joined else "\n"
        self.marked = re.compile(f"([^\\W\\d_]+)([^\\w{SPACE}{alone}]+)")  # letters, then marks
        self.cut = None if inner else re.compile(
            f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|{alone}+" if alone else "")
        )

    def merged(self, text: str) -> list[str]:
        """Merge adjacent symbols, best score first, leftmost on ties: the definition itself."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.score.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return symbols
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]

    def _symbol(self, piece: str) -> int:
        return self.ids[piece] if piece in self.ids else self.count + ord(piece)

    def _written(self, symbol: int) -> str:
        return self.pieces[symbol] if symbol < self.count else chr(symbol - self.count)

    def _fits(self, pair: int) -> bool:
        """Whether a symbol may follow the symbol before it (NONE at the start)."""
        before, symbol = divmod(pair, self.span)
        left, right = "" if before == self.span else self._written(before), self._written(symbol)
        return self.merged(left + right) == ([left, right] if left else [right])

    def split(self, text: str) -> list[str]:
        """The pieces of a text in which spaces are already written as the vocabulary does."""
        return [self._written(s) for s in self._symbols(text)]

    def _symbols(self, text: str) -> list[int]:
        n = len(text)
        lengths, count, span = self.lengths, self.count, self.span
        longest = [NONE] * n
        for end, symbol in self.matcher.iter(text):
            longest[end + 1 - lengths[symbol]] = symbol
        if NONE in longest:
            longest = [count + ord(c) if s == NONE else s for c, s in zip(text, longest)]
        longest.append(NONE)
        failed = bytearray(n + 1)
        fits, shorter = self.fits, self.shorter
        path: list[int] = []
        before, position, symbol = span, 0, longest[0]
        while position < n:
            if symbol == NONE:
                failed[position] = 1
                symbol = path.pop()
                before = path[-1] if path else span
                position -= lengths[symbol] if symbol < count else 1
                symbol = shorter[symbol] if symbol < count else NONE
                continue
            end = position + (lengths[symbol] if symbol < count else 1)
            if not failed[end] and fits[before * span + symbol]:
                path.append(symbol)
                before, position, symbol = symbol, end, longest[end]
            else:
                symbol = shorter[symbol] if symbol < count else NONE
        return path

    def _ids(self, chunk: str) -> list[int]:
        symbols = self._symbols(chunk)
        if max(symbols, default=0) < self.count:
            return symbols
        return [i for s in symbols for i in (
            [s] if s < self.count else [self.byte_id[b] for b in chr(s - self.count).encode()]
        )]

    def _chunk(self, chunk: str) -> tuple[str, str]:
        # characters that no piece has side by side are never merged: a part each
        if not chunk.lstrip(SPACE).isalpha():
            adjacent, start, parts = self.adjacent, 0, []
            for i in range(1, len(chunk)):
                if chunk[i - 1:i + 1] not in adjacent:
                    parts.append(chunk[start:i])
                    start = i
            if parts:
                known = [self.chunks[p] for p in (*parts, chunk[start:])]
                return ",".join([p[0] for p in known]), "".join([p[1] for p in known])
        return self._part(chunk)

    def _part(self, part: str) -> tuple[str, str]:
        ids, names = self._ids(part), self.names
        return ",".join([names[i] for i in ids]), self._text(ids)

    def _word(self, word: str) -> tuple[str, str]:
        """A word and the space before it."""
        if word.isalpha():
            return self._part(SPACE + word)
        marked = self.marked.fullmatch(word)
        if marked and word[marked.end(1) - 1:marked.end(1) + 1] not in self.adjacent:
            # the word is known, or will be, without its marks
            ids, text = self.words[marked[1]]
            more, marks = self.chunks[marked[2]]
            return f"{ids},{more}", text + marks
        known = [self.chunks[p] for p in self.cut.findall(SPACE + word)]
        return ",".join([p[0] for p in known]), "".join([p[1] for p in known])

    def encode_parts(self, text: str) -> list[tuple[str, str]]:
        """Per part of the text its ids, written with commas, and those ids decoded."""
        if not text:
            return []
        if self.cut is None:
            return [self._chunk(SPACE + text.replace(" ", SPACE))]
        if text[0] != " " and "  " not in text and SPACE not in text:
            return list(map(self.words.__getitem__, text.split(" ")))
        return list(map(self.chunks.__getitem__, self.cut.findall(SPACE + text.replace(" ", SPACE))))

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.encode_parts(text) for i in ids.split(",")]

    def _text(self, ids: list[int]) -> str:
        texts = [self.plain[i] for i in ids]
        try:
            return "".join(texts)
        except TypeError:  # bytes among them
            pass
        out: list[str] = []
        held = bytearray()
        for i, text in zip(ids, texts):
            if text is None:
                held.append(self.bytes[i])
                continue
            out += _utf8(held), text
            held = bytearray()
        return "".join(out) + _utf8(held)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the space that encoding puts in front."""
        text = self._text(ids)
        first = next((i for i in ids if i not in self.silent), self.unknown)
        return text[1:] if first not in self.bytes and self.pieces[first].startswith(SPACE) else text


def _utf8(data: bytearray) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        return data[:e.start].decode() + "�" + _utf8(data[e.start + 1:])


def tokenizer(model_file: str) -> PieceTokenizer:
    return per_worker(("pieces", model_file), lambda: PieceTokenizer(model_file))


def map_encoded(
    docs: DataFrame, model_file: str, emit: Callable[[str, str], tuple], schema: str,
    keep: tuple[str, ...] = ("doc_id",), text: str = "text",
) -> DataFrame:
    """The kept columns and what `emit(ids with commas, decoded text)` gives for each document.

    A null or empty text has no ids and decodes to the empty text.  Every row is encoded on
    its own: repeated rows, null ids and further columns make no difference; a kept column
    that carries a new column's name is replaced.  Nothing is
    shuffled; the words of a worker's texts are memorised up to CHUNKS_KEPT.
    """
    new = {f.name for f in StructType.fromDDL(schema)}
    keep = tuple(c for c in keep if c not in new)
    kept = docs.select(*(f"`{c}`" for c in keep), whole_text(text).alias("_text"))
    types = dict(docs.dtypes)

    def rows(batches) -> Iterator[tuple]:
        coder = tokenizer(model_file)
        for batch in batches:
            *others, texts = (c.to_pylist() for c in batch.columns)
            for i, t in enumerate(texts):
                parts = coder.encode_parts(t)
                ids = ",".join(map(_first, parts))
                decoded = "".join(map(_second, parts))
                yield (*(o[i] for o in others), *emit(ids, decoded[1:]))

    return map_rows(kept, rows, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", " + schema)


def _ids_and_text(ids: str, decoded: str) -> tuple:
    # four bytes an id, where a list of numbers takes forty while a batch is held
    return np.fromstring(ids, np.int32, sep=","), decoded


def _digests(ids: str, decoded: str) -> tuple:
    n = ids.count(",") + 1 if ids else 0
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encode_documents(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, `ids` and the text `decoded` from them."""
    return map_encoded(docs, model_file, _ids_and_text, "ids array<int>, decoded string", keep)


def encoding_digests(docs: DataFrame, model_file: str) -> DataFrame:
    return map_encoded(docs, model_file, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """`doc_id` and the `text` of its `ids`; null ids are no ids, null entries are skipped."""

    def rows(batches) -> Iterator[tuple]:
        coder = tokenizer(model_file)
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield doc, coder.decode([i for i in ids or [] if i is not None])

    kind = dict(encoded.dtypes)["doc_id"]
    return map_rows(encoded.select("doc_id", F.col("ids")), rows, f"doc_id {kind}, text string")
