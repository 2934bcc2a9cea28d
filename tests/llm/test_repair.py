"""Conversation repair against exhaustive edits, the textbook parse over all splits, and a long conversation in segments."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from placetrace.llm import repair

RIGHT = re.compile(r"(s?(ua)+)?")
FIELDS = "conv_id long, turn long, role string, text string"
DIGEST = ("conv_id", *repair.REPORT, "repaired_sha256")


def exhaustive(rows):
    """Least (cost, audit) over all edits with at most two insertions in each place; rows: (initial, fault)."""
    best = None
    for inserts in product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
        for edits in product("DKRS", repeat=len(rows)):
            cost, audit, out = 2 * len(inserts[0]), "I" * len(inserts[0]), inserts[0]
            for (initial, fault), edit, more in zip(rows, edits, inserts[1:], strict=True):
                if edit != "D" and fault in ("blank", "duplicate"):
                    break
                cost += {"D": 3, "K": 0, "R": 2, "S": 2}[edit] + (edit != "D" and fault == "truncated") + 2 * len(more)
                audit += edit.replace("S", "R") + "I" * len(more)
                out += {"D": "", "K": initial, "R": "u", "S": "a"}[edit] + more
            else:
                if RIGHT.fullmatch(out) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def test_repairs_equal_exhaustive_edits():
    choice = random.Random(5)
    kinds = [(i, f) for i in "suax" for f in (None, "truncated", "blank", "duplicate")]
    for n in (0, 1, 2, 3):
        for _ in range(6 if n == 3 else 40):
            rows = [choice.choice(kinds) for _ in range(n)]
            signs = "".join(repair.symbol(*r) for r in rows)
            assert repair.best_repair(repair.span_cell(signs)) == exhaustive(rows), rows


def all_splits(signs):
    """The parse table by every split of every span."""
    n = len(signs)
    cells = {(i, i + 1): repair.ROW_CELLS[s] for i, s in enumerate(signs)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            options = [repair.combine(cells[i, k], cells[k, i + length]) for k in range(i + 1, i + length)]
            cells[i, i + length] = tuple(min(filter(None, c), default=None) for c in zip(*options, strict=True))
    return cells[0, n]


@pytest.mark.parametrize("seed", range(6))
def test_one_split_equals_all_splits(seed):
    choice = random.Random(seed)
    signs = "".join(choice.choices("suaxSUAX-", weights=[1, 6, 6, 1, 1, 2, 2, 1, 2], k=24))
    assert all_splits(signs) == repair.span_cell(signs)


def walked(rows):
    """The whole contract row by row for rows (turn, role, text) of one conversation as they are in order."""
    names = {"s": "system", "u": "user", "a": "assistant"}
    seen, marks, roles = set(), [], [r for _, r, _ in rows]
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        marks.append(fault)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    signs = "".join(repair.symbol(r[:1], f) for r, f in zip(roles, marks, strict=True))
    cost, audit = repair.best_repair(repair.span_cell(signs))
    lines, at, kept = [], iter(rows), len(audit) - audit.count("D")
    wanted = iter("s" * (kept % 2) + "ua" * (kept // 2))
    for edit in audit:
        _, role, text = (None, "", "") if edit == "I" else next(at)
        if edit != "D":
            name = names[next(wanted)]
            lines.append(f"{role if edit == 'K' else name}:{text}")
    assert next(at, None) is None
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    counts = [marks.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, digest)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = role if role is not None else " ", text if text is not None else " "
        hit = zlib.crc32(name.encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def by_hand(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in damaged([r for r in rows if r[0] == conv])]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        found[conv] = walked(mine) if mine else empty
    return found


def made(spark, rows):
    found = repair.damage_and_repair(spark.createDataFrame(rows, FIELDS)).select(*DIGEST).collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: tuple(r)[1:] for r in found}


def sample(n, seed):
    choice = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", "Is it?", "So it is!", "half a sentence", "é … "]
    return [
        (conv, turn, choice.choice(["system", "user", "assistant", "user", "assistant", "tool"]), choice.choice(texts))
        for conv in range(n)
        for turn in range(choice.randrange(1, 12))
        if choice.random() < 0.9
    ]


def test_conversations_equal_a_walk(spark):
    rows = sample(60, 1)
    rows += [(None, t, "user", f"Row {t}.") for t in range(4)] + [(7000, None, None, None), (7000, None, "user", "Hm.")]
    rows += [(7001, 3, "user", "Same."), (7001, 3, "user", "Same."), (7001, 3, "assistant", "Same."), (7001, 9, "", "Z.")]
    rows += [(7002, t, "user" if t % 2 == 0 else "assistant", "word " * 20000 + ".") for t in range(3)]
    assert made(spark, rows) == by_hand(rows)


def test_a_long_conversation_is_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 16)
    choice = random.Random(3)
    rows = [(1, t, choice.choice(["user", "assistant"]), f"Text {choice.randrange(300)}.") for t in range(900)]
    rows += [(1, 5, "user", "again.")] * 70 + sample(5, 2)
    rows = [(r[0] + 1 if r[0] != 1 else 1, *r[1:]) for r in rows]
    assert made(spark, rows) == by_hand(rows)


def test_no_rows_and_extra_columns(spark):
    assert repair.damage_and_repair(spark.createDataFrame([], FIELDS)).collect() == []
    rows = [(c, t, r, x, 1, "d", True) for c, t, r, x in sample(3, 9)]
    wide = spark.createDataFrame(rows, FIELDS + ", n int, digest string, heads boolean")
    found = {r.conv_id: tuple(r)[1:] for r in repair.damage_and_repair(wide).select(*DIGEST).collect()}
    assert found == by_hand([r[:4] for r in rows])


def test_repaired_rows_read_right(spark):
    rows = spark.createDataFrame(sample(20, 4), FIELDS)
    found = repair.repaired(rows, repair.parse(rows)).collect()
    by_conv = {}
    for r in sorted(found, key=lambda r: (r.conv_id, r.position)):
        by_conv.setdefault(r.conv_id, []).append(r)
    for mine in by_conv.values():
        assert [r.position for r in mine] == list(range(len(mine)))
        assert RIGHT.fullmatch("".join(r.role[0] for r in mine))
        assert all(r.text == "" for r in mine if r.edit == "I")
