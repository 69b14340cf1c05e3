"""Repair of conversations: faulty turns found, and the cheapest edits to a legal turn order.

1. Turns are put in one total order over all conversations (range partitions and running
   counts, so a conversation may be as long as it likes) as narrow rows: the initial of the
   role, a fault, and a hash of the text.
2. A turn whose role and text came before is one whose place is not the first of its hash.
3. The order is cut in blocks.  A task works out the cheapest audits of each conversation's
   part of a block, from each state that it may begin in (`audit.py`).
4. Parts, and the turns themselves, meet by conversation in order: one pass joins the parts
   to an audit and applies it to the turns as they stream by.  A conversation's texts are
   never held together; its audit is, as it is one value of the result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtrail.llm import audit as U
from readtrail.llm.common import map_rows, temporary_tables, with_positions

BLOCK = 4096  # turns whose audits are worked out together
TURNS = "conv_id long, turn long, role string, text string"
_BLANK = r"\x20\x09-\x0D"
_PATH = "struct<state: int, next: int, cost: long, audit: string>"
_PART = (f"conv_id long, block long, first string, last string, first_turn long, last_turn long, n_turns long, low long, "
         f"high long, blank long, duplicate long, truncated long, illegal long, paths array<{_PATH}>")
_LEGAL = {"su", "ua", "au"}
_NAMES = {U.USER: "user", U.ASSISTANT: "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """The check's damage: by a hash of (conversation, turn), turns are lost, emptied, cut, repeated, given a role."""
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    )
    rows = _filled(conversations).withColumn("_kind", F.crc32(key.cast("binary")) % 20).where("_kind != 0")
    text, kind = F.col("text"), F.col("_kind")
    changed = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_copy"),
    )
    return changed.drop("_copy")


def _filled(turns: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role"), blank("text"))


def _digest() -> Column:
    return F.sha2(F.col("text"), 256)


def _order() -> list[Column]:
    """By turn; turns of one number go by role, then by a hash of the text."""
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def _marked(turns: DataFrame) -> DataFrame:
    """Narrow turns with `_position` and `fault`, the first of blank, duplicate, truncated (0: none)."""
    text = F.col("text")
    own = (
        F.when(~text.rlike(f"[^{_BLANK}]"), U.BLANK)
        .when(~text.rlike(rf"[.!?][{_BLANK}]*\z"), U.TRUNCATED).otherwise(0)
    )
    narrow = turns.select("conv_id", "turn", "role", _digest().alias("digest"), own.alias("own"))
    placed = with_positions(narrow, _order(), "dialogue-turns")
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("_position").alias("_first")).select("_first")
    return placed.join(firsts, F.col("_position") == F.col("_first"), "left").select(
        "_position", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"),
        F.when((F.col("own") != U.BLANK) & F.col("_first").isNull(), U.DUPLICATE).otherwise(F.col("own")).alias("fault"),
    )


def _part(conv: int | None, block: int, rows: list[tuple], begins: bool) -> tuple:
    """Summary of a conversation's turns (turn, initial, fault) in one block."""
    initials = [r[1] if r[1] in ("s", "u", "a") else "?" for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    faults = [r[2] for r in rows]
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
    paths = [
        {"state": s, "next": t, "cost": cost, "audit": text}
        for s in ((U.START,) if begins else (U.START, U.SYSTEM, U.USER, U.ASSISTANT))
        for t, (cost, text) in U.over_turns(list(zip(initials, faults)), s).items()
    ]
    return (conv, block, initials[0], initials[-1], turns[0] if turns else None, turns[-1] if turns else None,
            len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None,
            faults.count(U.BLANK), faults.count(U.DUPLICATE), faults.count(U.TRUNCATED), illegal, paths)


def _parts(marked: DataFrame) -> DataFrame:
    def rows(batches) -> Iterator[tuple]:
        held: list[tuple] = []
        at: tuple | None = None
        begins = False
        for batch in batches:
            for position, conv, turn, initial, fault, block in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (block, conv):
                    if held:
                        yield _part(at[1], at[0], held, begins)
                    # behind another conversation of its block, a conversation begins here
                    begins = at is not None and at[0] == block or position == 0
                    at, held = (block, conv), []
                held.append((turn, initial, fault))
        if held:
            yield _part(at[1], at[0], held, begins)

    block = F.floor(F.col("_position") / BLOCK).alias("block")
    cut = marked.select("_position", "conv_id", "turn", "initial", "fault", block)
    return map_rows(cut.repartition("block").sortWithinPartitions("_position"), rows, _PART)


class _Repair:
    """State of one conversation in the last pass: its parts, then its turns in order."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.parts, self.edits, self.state = conv, [], None, U.START

    def found(self) -> dict:
        """Counts, cost and audit, once all parts are there."""
        parts = self.parts
        out = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
        out["illegal"] += sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(parts, parts[1:]))
        numbered = [p for p in parts if p["n_turns"]]
        distinct = sum(p["n_turns"] for p in numbered) - sum(
            a["last_turn"] == b["first_turn"] for a, b in zip(numbered, numbered[1:])
        )
        out["gaps"] = numbered[-1]["high"] - numbered[0]["low"] + 1 - distinct if numbered else 0
        blocks = []
        for p in parts:
            block: dict[int, dict[int, tuple[int, str]]] = {}
            for path in p["paths"]:
                block.setdefault(path["state"], {})[path["next"]] = (path["cost"], path["audit"])
            blocks.append(block)
        out["cost"], out["audit"] = U.over_blocks(blocks) if blocks else (0, "")
        self.edits = re.finditer(r"I*[DKR]|I+\Z", out["audit"])
        self.parts = []
        return out

    def _inserted(self, n: int) -> Iterator[tuple[str, str, str]]:
        for _ in range(n):
            self.state = U.ASSISTANT if self.state == U.USER else U.USER
            yield _NAMES[self.state], "", "I"

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Repaired turns (role, text, edit) that come of the next turn."""
        edit = next(self.edits).group()
        yield from self._inserted(len(edit) - 1)
        if edit[-1] == "K":
            self.state = {"s": U.SYSTEM, "u": U.USER, "a": U.ASSISTANT}[role[0]]
            yield role, text, "K"
        elif edit[-1] == "R":
            self.state = U.ASSISTANT if self.state == U.USER else U.USER
            yield _NAMES[self.state], text, "R"

    def end(self) -> Iterator[tuple[str, str, str]]:
        for edit in self.edits:
            yield from self._inserted(len(edit.group()))


Emit = Callable[[Iterator["tuple[_Repair, dict, Iterator[tuple[str, str, str]]]"]], Iterator[tuple]]


def _repaired(turns: DataFrame, ids: DataFrame, emit: Emit, schema: str) -> DataFrame:
    """What `emit` makes of every conversation of `ids` or `turns`: (repair, findings, repaired turns)."""
    turns = _filled(turns)
    parts = _parts(_marked(turns))
    fields = [c for c in parts.columns if c not in ("conv_id", "block")]
    nothing = [F.lit(None).cast(t).alias(c) for c, t in parts.dtypes if c in fields]
    texts = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "string"))]
    stream = (
        ids.select(F.col("conv_id").cast("long")).distinct().select("conv_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), *nothing, *texts)
        .unionByName(parts.select("conv_id", F.lit(1).alias("kind"), "block", *fields, *texts))
        .unionByName(turns.select("conv_id", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("block"), *nothing,
                                  "turn", "role", "text", _digest().alias("digest")))
    )
    conv, *within = _order()
    ordered = stream.repartition("conv_id").sortWithinPartitions(conv, "kind", "block", *within)
    columns = ["conv_id", "kind", *fields, "role", "text"]

    def rows(batches) -> Iterator[tuple]:
        def events() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        source = events()
        ahead = next(source, None)

        def following(repair: _Repair) -> Iterator[tuple[str, str, str]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == repair.conv:
                yield from repair.turn(ahead[-2], ahead[-1])
                ahead = next(source, None)
            yield from repair.end()

        def conversations():
            nonlocal ahead
            while ahead is not None:
                repair = _Repair(ahead[0])
                while ahead is not None and ahead[0] == repair.conv and ahead[1] < 2:
                    if ahead[1] == 1:
                        repair.parts.append(dict(zip(fields, ahead[2:-2])))
                    ahead = next(source, None)
                found = repair.found()
                yield repair, found, following(repair)

        return emit(conversations())

    return map_rows(ordered.select(*columns), rows, schema)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: `conv_id`, `place` (from 0), `role`, `text` and the `edit` each turn came of.

    Turns (conv_id, turn, role, text) go by number, null first; null roles and texts are one
    blank.  Rows without a conversation id are one conversation.  Repeated rows are
    duplicates of their first.  Deleted turns give no row, so a conversation may vanish.
    Further columns are not looked at.
    """

    def emit(conversations) -> Iterator[tuple]:
        for repair, _, left in conversations:
            for place, (role, text, edit) in enumerate(left):
                yield repair.conv, place, role, text, edit

    with temporary_tables(turns.sparkSession) as kept:
        out = _repaired(turns, turns, emit, "conv_id long, place long, role string, text string, edit string")
        return kept(out, "dialogues")


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Per conversation the faults of its damaged turns, the audit of its repair and a hash of the result.

    Conversations that lose all of their turns have zeros and an empty audit.
    """

    def emit(conversations) -> Iterator[tuple]:
        for repair, found, left in conversations:
            digest = hashlib.sha256()
            for place, (role, text, _) in enumerate(left):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield (repair.conv, found["gaps"], found["blank"], found["duplicate"], found["truncated"],
                   found["illegal"], found["cost"], found["audit"], digest.hexdigest())

    schema = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
              "audit string, repaired_sha256 string")
    with temporary_tables(conversations.sparkSession) as kept:
        return kept(_repaired(damaged(conversations), conversations, emit, schema), "dialogue-digests")
