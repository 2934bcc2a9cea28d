"""Repair of conversation structure by weighted interval parsing.

A conversation is right if its role initials read ``(s?(ua)+)?``.  Rows can be kept
(0), given another role (R, 2) or deleted (D, 3; rows that are blank or repeat an
earlier one must be), and empty rows inserted (I, 2); a cut-off text that stays
costs 1.  The repair grammar is in Chomsky normal form: a nonterminal is a pair of
states (from, to) of the wanted pattern, its binary rules are (p, q) -> (p, r)(r, q),
its terminals the edits of one row, each closed under insertions after it.

A cell of a span holds the least (cost, audit) for every nonterminal, the audit
being the letters of the edits.  Letters fix costs, so audits of equal cost are
never beginnings of each other and the order of texts is kept by concatenation.
Cells are combined bottom-up by span length.  As every derivation of a pair can be
split at any row, one split of a span gives the same cell as all of them; spans
double, and a conversation needs as many combinations as it has rows.

Rows travel without their texts, sorted into ranges by conversation and turn: a long
conversation is cut over tasks into segments, whose cells are combined at the end.
Texts are shuffled once, to be laid out as repaired.  The digest of a conversation
is a chain over its rows, so that step streams through one conversation in one
task, a row at a time.

Edge cases: nulls in role and text count as one space; a null turn comes first, a
null conv_id is a conversation of its own; equal turns go by role, then by digest of
the text, and repeated rows stand together; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.llm.tables import stored

BLANKS = " \t\n\x0b\f\r"
STATES = "0SUA"  # nothing yet, after the system row, after a user row, after an assistant row
STEPS = {"s": ("0S",), "u": ("0U", "SU", "AU"), "a": ("UA",)}  # what a row of each role leads from and to
PAIRS = tuple(p + q for p in STATES for q in STATES if q != "0" or p == "0" if q != "S" or p in "0S")
PLACE = {pair: i for i, pair in enumerate(PAIRS)}
RULES = tuple(
    tuple((PLACE[pair[0] + r], PLACE[r + pair[1]]) for r in STATES if pair[0] + r in PLACE and r + pair[1] in PLACE)
    for pair in PAIRS
)
RECAST, DELETE, INSERT, CUT = 2, 3, 2, 1
SEGMENT = 4096


def combine(left, right):
    """The cell of two neighbouring spans."""
    out = []
    for rules in RULES:
        best = None
        for i, j in rules:
            a, b = left[i], right[j]
            if a is not None and b is not None:
                cost = a[0] + b[0]
                if best is None or cost < best[0] or (cost == best[0] and a[1] + b[1] < best[1]):
                    best = (cost, a[1] + b[1])
        out.append(best)
    return tuple(out)


def _cell(options):
    """The least of (pair, cost, audit) for each pair."""
    out = [None] * len(PAIRS)
    for pair, cost, audit in options:
        at = PLACE[pair]
        out[at] = (cost, audit) if out[at] is None else min(out[at], (cost, audit))
    return tuple(out)


def _insertions():
    """The cell of a span without rows: any number of inserted rows, two at most without a detour."""
    none = _cell([(p + p, 0, "") for p in STATES])
    one = _cell([(pair, INSERT, "I") for role in "ua" for pair in STEPS[role]])
    some = tuple(min(filter(None, pair), default=None) for pair in zip(none, one, strict=True))
    return combine(some, some)


INSERTIONS = _insertions()


def symbol(initial, fault):
    """One character for what the grammar sees of a row: ``-`` to be deleted, upper case if cut off."""
    if fault in ("blank", "duplicate"):
        return "-"
    known = initial if initial in ("s", "u", "a") else "x"
    return known.upper() if fault == "truncated" else known


def row_cell(sign):
    """The cell of one row: its edits, and insertions after it."""
    options = [(p + p, DELETE, "D") for p in STATES]
    if sign != "-":
        more = CUT if sign.isupper() else 0
        options += [(pair, more, "K") for pair in STEPS.get(sign.lower(), ())]
        options += [(pair, RECAST + more, "R") for role in "ua" for pair in STEPS[role]]
    return combine(_cell(options), INSERTIONS)


ROW_CELLS = {sign: row_cell(sign) for sign in "suaxSUAX-"}


@lru_cache(1 << 16)
def _short(signs):
    return _pairwise([ROW_CELLS[s] for s in signs])


def _pairwise(cells):
    """Combine neighbours until one cell is left: spans of a length, then of twice the length."""
    while len(cells) > 1:
        paired = [combine(cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
        cells = paired + cells[len(paired) * 2 :]
    return cells[0] if cells else _cell([(p + p, 0, "") for p in STATES])


def span_cell(signs):
    """The cell of a span of rows; short spans recur and are remembered."""
    return _pairwise([_short(signs[i : i + 8]) for i in range(0, len(signs), 8)])


def best_repair(cell):
    """(cost, audit) of a whole conversation."""
    whole = combine(INSERTIONS, cell)
    return min(filter(None, (whole[PLACE["00"]], whole[PLACE["0A"]])))


COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
EDGES = ("first_initial", "last_initial")
TURNS = ("first_turn", "last_turn")
LEGAL = ("su", "ua", "au")


class Segment:
    """What is known of neighbouring rows of one conversation: counts, edges and the cell."""

    def __init__(self):
        self.count = dict.fromkeys(COUNTS, 0)
        self.edge = dict.fromkeys(EDGES)
        self.turn = dict.fromkeys(TURNS)
        self.signs = []

    def add(self, turn, initial, fault, n):
        """``n`` equal rows, the first with ``fault``; the others repeat it."""
        count, edge = self.count, self.edge
        faults = [(fault, 1)] if n == 1 else [(fault, 1), ("blank" if fault == "blank" else "duplicate", n - 1)]
        for kind, times in faults:
            if kind:
                count[kind] += times
            self.signs.append(symbol(initial, kind) * times)
        before = edge["last_initial"]
        count["illegal"] += (before is not None and before + initial not in LEGAL) + (n - 1) * (initial * 2 not in LEGAL)
        if edge["first_initial"] is None:
            edge["first_initial"] = initial
        edge["last_initial"] = initial
        if turn is not None and turn != self.turn["last_turn"]:
            count["turns"] += 1
            if self.turn["first_turn"] is None:
                self.turn["first_turn"] = turn
            self.turn["last_turn"] = turn
        count["rows"] += n

    def row(self, conv_id, part, at):
        cell = span_cell("".join(self.signs))
        costs = [None if c is None else c[0] for c in cell]
        audits = [None if c is None else c[1] for c in cell]
        return (conv_id, part, at, *self.count.values(), *self.edge.values(), *self.turn.values(), costs, audits)


def _schema(conv_type):
    counts = ", ".join(f"{c} long" for c in COUNTS)
    edges = ", ".join(f"{c} string" for c in EDGES) + ", " + ", ".join(f"{c} long" for c in TURNS)
    return f"conv_id {conv_type}, part int, at long, {counts}, {edges}, costs array<long>, audits array<string>"


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def _arrow_segments(conv_type):
    kinds = [("conv_id", conv_type), ("part", pa.int32()), ("at", pa.int64())]
    kinds += [(c, pa.int64()) for c in COUNTS] + [(c, pa.string()) for c in EDGES] + [(c, pa.int64()) for c in TURNS]
    return pa.schema([*kinds, ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _segments(batches):
    """mapInArrow on sorted rows: a row for each run of at most ``SEGMENT`` rows of one conversation."""
    part, at, held, conv, schema, made = TaskContext.get().partitionId(), 0, None, None, None, []
    for batch in batches:
        schema = schema or _arrow_segments(batch.schema.field("conv_id").type)
        for row in batch.to_pylist():
            n = row["n"]
            while n:
                if held is not None and (row["conv_id"] != conv or held.count["rows"] >= SEGMENT):
                    made.append(held.row(conv, part, at))
                    held, at = None, at + 1
                if held is None:
                    held, conv = Segment(), row["conv_id"]
                some = min(n, SEGMENT - held.count["rows"])
                fault = row["fault"] if n == row["n"] else ("blank" if row["fault"] == "blank" else "duplicate")
                held.add(row["turn"], row["initial"], fault, some)
                n -= some
            if len(made) >= 512:
                yield _batch(made, schema)
                made = []
    if held is not None:
        made.append(held.row(conv, part, at))
    if made:
        yield _batch(made, schema)


def _reports(batches):
    """mapInArrow on sorted segments: the report of each conversation."""

    def report(conv, parts):
        cells = []
        total = dict.fromkeys(COUNTS, 0)
        last_initial = first_turn = last_turn = None
        for part in parts:
            cells.append((0, tuple(None if c is None else (c, a) for c, a in zip(part["costs"], part["audits"], strict=True))))
            while len(cells) > 1 and cells[-1][0] == cells[-2][0]:
                right, left = cells.pop(), cells.pop()
                cells.append((left[0] + 1, combine(left[1], right[1])))
            for name in COUNTS:
                total[name] += part[name]
            total["illegal"] += last_initial is not None and last_initial + part["first_initial"] not in LEGAL
            last_initial = part["last_initial"]
            if part["first_turn"] is not None:
                total["turns"] -= part["first_turn"] == last_turn
                first_turn = part["first_turn"] if first_turn is None else first_turn
                last_turn = part["last_turn"]
        cost, audit = best_repair(reduce(lambda right, left: combine(left, right), (c for _, c in reversed(cells))))
        gaps = 0 if first_turn is None else last_turn - first_turn + 1 - total["turns"]
        return (conv, gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], cost, audit)

    def sent(rows, conv_type):
        kinds = [pa.int64()] * 6
        schema = pa.schema([("conv_id", conv_type), *zip(REPORT, [*kinds, pa.string()], strict=True)])
        return _batch(rows, schema)

    held, made, conv_type = [], [], None
    for batch in batches:
        conv_type = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if held and held[0]["conv_id"] != row["conv_id"]:
                made.append(report(held[0]["conv_id"], held))
                held = []
            held.append(row)
            if len(made) >= 4096:
                yield sent(made, conv_type)
                made = []
    if held:
        made.append(report(held[0]["conv_id"], held))
    if made:
        yield sent(made, conv_type)


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
ORDER = ("turn", "role", "digest")


def _rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text without nulls in role and text, and a digest of the text."""
    space = F.lit(" ")
    text = F.coalesce(F.col("text").cast("string"), space)
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )


def parse(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation."""
    spoken = F.rtrim(F.col("text"), F.lit(BLANKS))
    cut = ~F.substring(spoken, -1, 1).isin(".", "!", "?")
    look = F.when(spoken == "", "blank").when(cut, "truncated").alias("look")
    # Equal rows of one turn stand together and travel as one.
    rows = _rows(conversations).select("conv_id", *ORDER, look)
    rows = rows.groupBy("conv_id", *ORDER, "look").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.groupBy(
        F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest")
    ).agg(F.min(place).alias("first"))
    same = (
        F.col("conv_id").eqNullSafe(F.col("f_conv"))
        & (F.col("role") == F.col("f_role"))
        & (F.col("digest") == F.col("f_digest"))
    )
    fault = F.when(F.col("look") == "blank", "blank").when(F.col("first") != place, "duplicate").otherwise(F.col("look"))
    known = stored(
        rows.join(first.hint("merge"), same).select(
            "conv_id", *ORDER, F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "n"
        )
    )
    keys = [F.asc_nulls_first(c) for c in ("conv_id", *ORDER)]
    kind = known.schema["conv_id"].dataType.simpleString()
    segments = (
        known.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("conv_id", "turn", "initial", "fault", "n")
        .mapInArrow(_segments, _schema(kind))
    )
    fields = ", ".join(f"{c} long" for c in REPORT[:-1])
    return (
        segments.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "at")
        .mapInArrow(_reports, f"conv_id {kind}, {fields}, audit string")
    )


def _laid_out(batches):
    """mapInArrow on sorted rows, each conversation headed by its audit: the repaired rows in order."""
    names = {"s": "system", "u": "user", "a": "assistant"}
    conv, audit, at, position, odd = None, "", 0, 0, 0

    def inserted(out):
        nonlocal at, position
        while at < len(audit) and audit[at] == "I":
            out.append((conv, position, "I", names[wanted()], ""))
            at, position = at + 1, position + 1

    def wanted():
        return "s" if odd and position == 0 else "ua"[(position - odd) % 2]

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["heads"]:
                conv, audit, at, position = row["conv_id"], row["text"], 0, 0
                odd = (len(audit) - audit.count("D")) % 2
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    out.append((conv, position, edit, row["role"] if edit == "K" else names[wanted()], row["text"]))
                    position += 1
            inserted(out)
        if out:
            schema = [("conv_id", batch.schema.field("conv_id").type), ("position", pa.int64())]
            schema += [("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
            yield _batch(out, pa.schema(schema))


def repaired(conversations: DataFrame, reports: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text) of the repaired conversations, each in order within one partition."""
    heads = reports.select(
        "conv_id", F.lit(True).alias("heads"), *[F.lit(None).cast(t).alias(c) for c, t in zip(ORDER, ("long", "string", "binary"))],
        F.col("audit").alias("text"),
    )
    rows = _rows(conversations).select("conv_id", F.lit(False).alias("heads"), *ORDER, "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return (
        heads.unionByName(rows)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.desc("heads"), *[F.asc_nulls_first(c) for c in ORDER])
        .select("conv_id", "heads", "role", "text")
        .mapInArrow(_laid_out, f"conv_id {kind}, position long, edit string, role string, text string")
    )


def _digests(batches):
    conv, sha, schema = None, None, None
    for batch in batches:
        schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("repaired_sha256", pa.string())])
        out = []
        for row in batch.to_pylist():
            if row["position"] == 0:
                if sha is not None:
                    out.append((conv, sha.hexdigest()))
                conv, sha = row["conv_id"], hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{row['role']}:{row['text']}".encode())
        if out:
            yield _batch(out, schema)
    if sha is not None:
        yield _batch([(conv, sha.hexdigest())], schema)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the rows of ``repaired``, in the same tasks; none for empty conversations."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows spoilt by the CRC of ``conv_id:turn``: dropped, emptied, without sentence signs, doubled or made the user's."""
    space = F.lit(" ")
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id",)], F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), space))
    hit = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce(F.col("text").cast("string"), space), F.coalesce(F.col("role").cast("string"), space)
    spoilt = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.where(hit != 0).select(
        "conv_id", "turn", F.when(hit == 4, "user").otherwise(role).alias("role"), spoilt.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """Every conv_id with the report on its damaged rows and the digest of their repair."""
    rows = damaged(conversations)
    reports = stored(parse(rows))
    found = digests(repaired(rows, reports))
    ids = conversations.select("conv_id").distinct()

    def beside(left, right):
        right = right.withColumnRenamed("conv_id", "__conv")
        return left.join(right, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")

    nothing = F.sha2(F.lit("").cast("binary"), 256)
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in REPORT[:-1]]
    return beside(beside(ids, reports), found).select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )
