import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from readtrail.llm import audit, dialogues
from readtrail.llm.audit import ASSISTANT, START, SYSTEM, USER

SCHEMA = "conv_id long, turn long, role string, text string, note string"
LEGAL = re.compile(r"(s?(ua)+)?")


def brute_audit(turns):
    """(cost, audit) by listing all edit strings of growing cost."""
    best = None
    n = len(turns)

    def walk(i, cost, edits, initials):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if not LEGAL.fullmatch(initials) and not LEGAL.fullmatch(initials + "a") and initials != "s":
            return
        if i == n and LEGAL.fullmatch(initials):
            best = min(best or (cost, edits), (cost, edits))
        if cost + 2 <= limit:
            for c in "ua":
                walk(i, cost + 2, edits + "I", initials + c)
        if i == n:
            return
        initial, fault = turns[i]
        walk(i + 1, cost + 3, edits + "D", initials)
        if fault not in (audit.BLANK, audit.DUPLICATE):
            extra = fault == audit.TRUNCATED
            walk(i + 1, cost + extra, edits + "K", initials + initial)
            for c in "ua":
                walk(i + 1, cost + 2 + extra, edits + "R", initials + c)

    limit = 3 * n
    walk(0, 0, "", "")
    return best or (0, "")


def whole(turns, modulus=None, cut=None):
    blocks = []
    for i in range(0, len(turns), cut or max(len(turns), 1)):
        states = (START, SYSTEM, USER, ASSISTANT) if i else (START,)
        blocks.append({s: audit.over_turns(turns[i:i + (cut or len(turns))], s, modulus) for s in states})
    return audit.over_blocks(blocks)


@pytest.mark.parametrize("modulus,cut", [(None, None), (2, None), (5, None), (None, 2), (3, 1)])
def test_audits_against_brute_force(modulus, cut):
    """Also with hashes that collide all the time, and joined from short blocks."""
    r = random.Random(1)
    for n in range(6):
        for _ in range(60):
            turns = [(r.choice("suaua?"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
            assert whole(turns, modulus, cut) == brute_audit(turns), turns


def test_long_audits_do_not_depend_on_blocks():
    r = random.Random(2)
    turns = [(r.choice("suaua"), r.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(3000)]
    want = whole(turns)
    assert whole(turns, cut=1000) == want
    assert whole(turns, modulus=97, cut=777) == want


def test_strings_in_a_forest_compare_like_strings():
    r = random.Random(3)
    for modulus in (2, 7, (1 << 61) - 1):
        forest = audit.Audits(modulus)
        nodes = {0: ""}
        for _ in range(150):
            node = r.choice(list(nodes))
            c = r.choice("DIKR"[:2])
            nodes[forest.add(node, c)] = nodes[node] + c
        for (x, a), (y, b) in itertools.product(nodes.items(), repeat=2):
            assert forest.less(x, y) == (a < b), (a, b)
            assert forest.text(x) == a


def brute(rows):
    conversations = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = conversations[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in conversations.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        seen, turns = set(), []
        for _, role, text in own:
            kept = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = (audit.BLANK if not kept else audit.DUPLICATE if (role, text) in seen
                     else audit.TRUNCATED if kept[-1] not in ".!?" else 0)
            seen.add((role, text))
            turns.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault))
        numbers = [t[0] for t in own if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, edits = brute_audit(turns) if len(turns) <= 6 else whole(turns)
        lines, last, rest = [], "", iter(own)
        for e in edits:
            if e == "I":
                last = "a" if last == "u" else "u"
                lines.append(f"{'user' if last == 'u' else 'assistant'}:")
                continue
            _, role, text = next(rest)
            if e == "K":
                last = role[0]
                lines.append(f"{role}:{text}")
            elif e == "R":
                last = "a" if last == "u" else "u"
                lines.append(f"{'user' if last == 'u' else 'assistant'}:{text}")
        count = [sum(f == k for _, f in turns) for k in (audit.BLANK, audit.DUPLICATE, audit.TRUNCATED)]
        out[conv] = (gaps, *count, illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talks(seed=4):
    r = random.Random(seed)
    rows = []
    for conv in range(220):
        for turn in range(r.randint(1, 6)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool"]) if r.random() < 0.5 else ["user", "assistant"][turn % 2]
            text = r.choice(["Yes.", "No!", "What? ", "and then", f"Turn {turn} of {conv}.", "", " \n", "A. B"])
            rows.append((conv, turn if r.random() < 0.9 else turn + 3, role, text, "x"))
    return rows + [
        (None, 1, "user", "Hi.", None), (None, None, None, None, None), (None, 2, "assistant", "Ho.", None),
        (901, None, "user", "One.", None), (901, None, "user", "One.", None), (902, 5, None, "Two.", None),
        (903, 1, "", "Empty role.", None), (903, 1, "user", "Tie.", None), (904, -5, "user", "é 😀.", None), (904, 7, "assistant", None, None),
    ]


def test_conversations_against_brute_force(spark):
    rows = talks()
    got = {r[0]: tuple(r)[1:] for r in dialogues.repair_digests(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == brute(rows)


def test_a_conversation_over_many_blocks(spark):
    r = random.Random(6)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice([f"t{t}.", f"u{t % 50}", "same."]), None) for t in range(3 * dialogues.BLOCK)]
    rows += [(c, t, ["user", "assistant"][t], "Fine.", None) for c in range(30) for t in range(2) if c != 7]
    got = {r[0]: tuple(r)[1:] for r in dialogues.repair_digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_repaired_turns_are_legal_and_keep_texts(spark):
    rows = talks(8)
    out = defaultdict(list)
    for r in dialogues.repaired_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect():
        out[r.conv_id].append(r)
    for conv, turns in out.items():
        assert LEGAL.fullmatch("".join(t.role[0] for t in turns))
        texts = {(r[3] if r[3] is not None else " ") for r in rows if r[0] == conv}
        assert all(t.text in texts if t.edit != "I" else t.text == "" for t in turns)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dialogues.repair_digests(none).collect() == [] == dialogues.repaired_turns(none).collect()
    # conversation 11, turn 0 and such: all turns lost
    lost = [(c, 0, "user", "x", None) for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = dialogues.repair_digests(spark.createDataFrame(lost, SCHEMA)).collect()
    assert len(got) == len(lost) > 0
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
