"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A passage of m characters with at most k edits keeps at least m - q + 1 - k * q
of the item's q-grams, all on neighbouring diagonals.  Documents are scanned for
the q-grams of the benchmark; shared ones are counted per item in overlapping
bands of diagonals, regions that reach the bound are kept, and a banded
alignment confirms the edit distance.  Texts are compared lower-cased, with runs
of other signs than letters and digits as one space.

The benchmark goes to the executors in blocks of bounded size, so a benchmark of
any size works; a block is one pass over the texts.

Edge cases: null or empty texts and items match nothing, as do items without a
letter or digit; items shorter than q must occur literally as whole words; null
ids of documents and items are passed through; repeated rows are reported each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.llm.tables import texts
from placetrace.llm.textkit import BASE, byte_codes, mix, pieces

Q = 12
BITS = 21
SCHEMA = "doc_id long, text_hash long, item_id long, distance int, start long, end long"


@dataclass(frozen=True)
class Settings:
    """``edit_rate`` is the edit budget per character; ``block_bytes`` bounds a block of items."""

    edit_rate: float = 0.05
    block_bytes: int = 4 << 20


def _folding():
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[i for i in range(128) if not chr(i).isalnum()]] = 32
    return table


def folded(data, offsets):
    """Folded bytes, offsets and, for each folded byte, its place in the piece."""
    x = _folding()[data]
    if len(x):
        latin = np.zeros(len(x), bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        x = np.where(latin, x + 32, x).astype(np.uint8)
    keep = np.ones(len(x), bool)
    if len(x):
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
        inner = offsets[:-1]
        keep[inner[inner < len(x)]] = True
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return x[keep], total[offsets], np.flatnonzero(keep)


def grams(x):
    """Hash of the Q bytes that start at each place."""
    h = byte_codes()[x]
    powers = {n: np.uint64(pow(BASE, n, 1 << 64)) for n in (1, 2, 4)}
    for n in (1, 2, 4):  # twice, four and eight bytes
        if len(h) <= n:
            return np.zeros(0, np.uint64)
        base = h if n != 4 else (four := h)
        h = base[:-n] * powers[n] + base[n:]
    if len(h) <= 4:
        return np.zeros(0, np.uint64)
    return mix(h[: len(h) - 4] * powers[4] + four[8 : 8 + len(h) - 4])


@dataclass
class Items:
    ids: list
    texts: list
    budgets: np.ndarray
    least: np.ndarray  # shared q-grams that the budget leaves
    codes: np.ndarray  # sorted q-gram hashes
    owner: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    short: list


def prepare(rows, settings) -> Items:
    ids, kept, budgets, least, short = [], [], [], [], []
    codes, owner, place = [], [], []
    for item_id, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        x = bytes(folded(raw, np.array([0, len(raw)]))[0]).strip()
        if not x:
            continue
        if len(x) < Q:
            short.append((item_id, x))
            continue
        budget = min(int(len(x) * settings.edit_rate), (len(x) - Q) // Q)
        h = grams(np.frombuffer(x, np.uint8))
        codes.append(h)
        owner.append(np.full(len(h), len(ids)))
        place.append(np.arange(len(h)))
        ids.append(item_id)
        kept.append(x)
        budgets.append(budget)
        least.append(len(x) - Q + 1 - budget * Q)
    none = np.zeros(0, np.int64)
    codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    order = np.argsort(codes, kind="stable")
    bitmap = np.zeros(1 << BITS, bool)
    bitmap[codes >> np.uint64(64 - BITS)] = True
    return Items(
        ids,
        kept,
        np.array(budgets, np.int64),
        np.array(least, np.int64),
        codes[order],
        np.concatenate(owner)[order] if owner else none,
        np.concatenate(place)[order] if place else none,
        bitmap,
        short,
    )


CELLS = 1 << 20
ENTRIES = 1 << 22


def aligned(jobs):
    """For each (item, region, budget, low, high) the least edit distance of the item to a part of the region, or None.

    Only diagonals low..high count; the result has the distance and the span in
    the region.  Jobs of like width run side by side, an item byte at a time; a job
    leaves as soon as all of its band is over its budget.
    """
    out = [None] * len(jobs)
    order = sorted(range(len(jobs)), key=lambda j: (jobs[j][4] - jobs[j][3], len(jobs[j][0])))
    open_jobs = []
    for j in order:
        item, region, *_ = jobs[j]
        at = region.find(item)
        if at >= 0:
            out[j] = (0, at, at + len(item))
        else:
            open_jobs.append(j)
    while open_jobs:
        width = jobs[open_jobs[0]][4] - jobs[open_jobs[0]][3] + 1
        n = max(1, CELLS // (width + len(jobs[open_jobs[0]][0])))
        some = [j for j in open_jobs[:n] if jobs[j][4] - jobs[j][3] < 2 * width]
        open_jobs = open_jobs[len(some) :]
        for j, result in zip(some, _side_by_side([jobs[j] for j in some]), strict=True):
            out[j] = result
    return out


def _side_by_side(jobs):
    size = np.array([len(item) for item, *_ in jobs])
    budget, low, high = (np.array([job[k] for job in jobs]) for k in (2, 3, 4))
    length = np.array([len(region) for _, region, *_ in jobs])
    width, m, far = int((high - low).max()) + 1, int(size.max()), 1 << 20
    x = np.zeros((len(jobs), m), np.int16)
    y = np.full((len(jobs), m + width), 256, np.int16)  # region byte at place i + diagonal
    for k, (item, region, _, first, _) in enumerate(jobs):
        x[k, : len(item)] = np.frombuffer(item, np.uint8)
        start, stop = max(0, first), min(len(region), first + m + width)
        if stop > start:
            y[k, start - first : stop - first] = np.frombuffer(region, np.uint8)[start:stop]
    columns = low[:, None] + np.arange(width)
    banded = columns <= high[:, None]
    row = np.where(banded & (columns >= 0) & (columns <= length[:, None]), 0, far)
    origin, steps, alive = columns.copy(), np.arange(width), np.arange(len(jobs))
    out = [None] * len(jobs)
    for i in range(m):
        best = row + (y[alive, i : i + width] != x[alive, i, None])
        up = np.full_like(row, far)
        up[:, :-1] = row[:, 1:] + 1
        take = up < best
        best = np.where(take, up, best)
        came = origin.copy()
        came[:, :-1] = np.where(take[:, :-1], origin[:, 1:], origin[:, :-1])
        end = columns + i + 1
        best = np.where(banded & (end >= 0) & (end <= length[alive, None]), best, far)
        shifted = best - steps  # insertions run along the row
        source = np.maximum.accumulate(np.where(shifted == np.minimum.accumulate(shifted, 1), steps, 0), 1)
        row = np.take_along_axis(best, source, 1) + steps - source
        origin = np.take_along_axis(came, source, 1)
        within = row.min(1) <= budget[alive]
        done = size[alive] == i + 1
        for k in np.flatnonzero(done & within):
            at = int(row[k].argmin())
            out[alive[k]] = (int(row[k, at]), int(origin[k, at]), int(columns[k, at] + i + 1))
        stay = within & ~done
        if not stay.any():
            break
        if not stay.all():
            alive, row, origin, columns, banded = alive[stay], row[stay], origin[stay], columns[stay], banded[stay]
    return out


def _regions(h, offsets, items):
    """(row, item, lowest and highest diagonal) of the band regions that reach the bound.

    A q-gram may be common to many items and recur in a text: items are taken in
    ranges, so that not all of such entries are there at once.
    """
    hits = np.flatnonzero(items.bitmap[h >> np.uint64(64 - BITS)])
    left = np.searchsorted(items.codes, h[hits])
    right = np.searchsorted(items.codes, h[hits], "right")
    hits, left, right = (v[right > left] for v in (hits, left, right))
    rows = np.searchsorted(offsets, hits, "right") - 1
    fits = hits + Q <= offsets[rows + 1]
    hits, left, right, rows = (v[fits] for v in (hits, left, right, rows))
    times = right - left
    if not len(times):
        return []
    parts = 1 + int(times.sum()) // ENTRIES
    found, edges = [], np.linspace(0, len(items.ids), parts + 1).astype(np.int64)
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        entries = []
        cuts = np.searchsorted(np.cumsum(times), np.arange(ENTRIES, int(times.sum()), ENTRIES)) + 1
        for some in np.split(np.arange(len(times)), np.unique(cuts)):
            n = times[some]
            which = np.repeat(left[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            mine = (items.owner[which] >= first) & (items.owner[which] < last)
            entries.append((np.repeat(rows[some], n)[mine], np.repeat(hits[some], n)[mine], which[mine]))
        found += _banded(*(np.concatenate(c) for c in zip(*entries, strict=True)), offsets, items)
    return sorted(found)


def _banded(rows, hits, which, offsets, items):
    """Regions of the shared q-grams given by text row, place in the piece and place among the q-grams of the items."""
    item = items.owner[which]
    diagonal = hits - offsets[rows] - items.place[which]
    step = items.budgets[item] + 1
    band = diagonal // step
    offset = 1 << 31
    pair = rows * len(items.ids) + item
    found = []
    for shift in (0, 1):  # each diagonal lies in two bands of two steps
        key = np.stack((pair, band - shift + offset, items.place[which]), 1)
        order = np.lexsort(key.T[::-1])
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(1)
        key = key[new]  # each q-gram of the item counts once in a band
        found.append(key)
    key = np.concatenate(found)
    order = np.lexsort(key.T[::-1])
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]).any(1)
    key = key[new]
    change = np.ones(len(key), bool)
    change[1:] = (key[1:, :2] != key[:-1, :2]).any(1)
    first = np.flatnonzero(change)
    counts = np.diff(np.append(first, len(key)))
    pair, band = key[first, 0], key[first, 1] - offset
    enough = counts >= items.least[pair % len(items.ids)]
    pair, band = pair[enough], band[enough]
    step = items.budgets[pair % len(items.ids)] + 1
    merged = []
    for p, low, high in zip(pair.tolist(), (band * step).tolist(), ((band + 2) * step - 1).tolist(), strict=True):
        if merged and merged[-1][0] == p and low <= merged[-1][2] + 1:
            merged[-1][2] = high
        else:
            merged.append([p, low, high])
    return [(p // len(items.ids), p % len(items.ids), low, high) for p, low, high in merged]


def matches(data, offsets, items):
    """(row, item id, distance, start, end) with byte places in the row, at most one for a row and item."""
    x, at, places = folded(data, offsets)
    h = grams(x)
    best, jobs, places_of = {}, {}, []
    for row, item, low, high in _regions(h, at, items) if len(items.codes) and len(h) else ():
        text, budget = items.texts[item], int(items.budgets[item])
        start = max(0, low - budget)
        region = bytes(x[at[row] + start : min(at[row + 1], at[row] + high + len(text) + budget + 1)])
        # Regions that read alike are aligned once.
        job = jobs.setdefault((text, region, budget, low - budget - start, high + budget - start), len(jobs))
        places_of.append((row, item, start, job))
    results = aligned(list(jobs))
    for row, item, start, job in places_of:
        result, budget = results[job], int(items.budgets[item])
        if result and result[0] < best.get((row, item), (budget + 1,))[0]:
            best[row, item] = (result[0], result[1] + start, result[2] + start)
    for (row, item), (distance, start, end) in sorted(best.items()):
        first = places[at[row] + start] - offsets[row]
        last = places[at[row] + max(start, end - 1)] - offsets[row] + 1
        yield row, items.ids[item], distance, int(first), int(last)
    if items.short:
        for row in range(len(offsets) - 1):
            text = b" " + bytes(x[at[row] : at[row + 1]]) + b" "
            for item_id, short in items.short:
                found = text.find(b" " + short + b" ")
                if found >= 0:
                    start = places[at[row] + found] - offsets[row]
                    yield row, item_id, 0, int(start), int(start) + len(short)


def _blocks(benchmark, settings):
    """Item rows in blocks of bounded bytes, each collected on its own."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    n = 1 + int(size // settings.block_bytes)
    for block in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        yield [(r.item_id, r.text) for r in part.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row for each document and item whose passage it holds: distance and byte span of the best match.

    ``text_hash`` is the xxhash64 of the text, which tells rows of one id apart.
    """
    context, out = docs.sparkSession.sparkContext, None
    for rows in _blocks(benchmark, settings):
        shared = context.broadcast(prepare(rows, settings))

        def scan(batches, shared=shared):
            items = shared.value
            for batch in batches:
                ids, found = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash")), strict=True)), []
                for at, _, data, offsets in pieces(batch.column("text")):
                    found += [(*ids[at + m[0]], *m[1:]) for m in matches(data, offsets, items)]
                columns = list(zip(*found, strict=True)) or [()] * 6
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=["doc_id", "text_hash", "item_id", "distance", "start", "end"],
                )

        part = texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(scan, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out
