"""Variable-capacity best-fit packing of token sequences.

Several sequence lengths are permitted at once.  Longest pieces first, a piece
goes into the open bin with the least sufficient room; if none has room, the
bin size of least cost is opened: cost is the size plus a fixed cost per bin,
per token that the piece and the pieces still to come can put into it.  In the
end each bin is downsized to the smallest permitted length that holds it.

Lengths are whole numbers up to the largest capacity, so the plan is made on the
histogram of lengths, whose size that capacity bounds: bins that are filled alike
are one range of bin numbers.  Rows then find their bin from their length and
their rank among the rows of that length, all on executors.

Edge cases: a null or empty text has only its end mark; a text longer than the
largest capacity is cut into pieces of that length and a rest, all kept; null
ids and repeated rows are packed each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.llm.ranks import rank_within, seeded
from placetrace.llm.tables import stored, texts
from placetrace.llm.textkit import pieces, separators, word_spans

CAPACITIES = (2048, 4096, 8192)


@dataclass
class Plan:
    """Placements sorted by length and first rank, and ranges of bins with their content."""

    placements: np.ndarray  # length, first rank, first bin, pieces per bin, tokens before
    bins: np.ndarray  # first bin, tokens in each bin of the range


def best_fit(histogram: dict[int, int], capacities=CAPACITIES, bin_cost=64) -> Plan:
    """Plan for ``histogram`` (pieces by length); its time follows the number of distinct lengths."""
    sizes = sorted(capacities)
    left = sum(length * n for length, n in histogram.items())
    rooms: list[int] = []  # distinct free amounts of open bins, ascending
    ranges: dict[int, list[tuple[int, int, int]]] = {}  # free: (first bin, bins, capacity)
    done: list[tuple[int, int]] = []
    placements, bins = [], 0

    def put(free, first, n, capacity):
        if n <= 0:
            return
        if free == 0:
            done.append((first, capacity))
            return
        if free not in ranges:
            bisect.insort(rooms, free)
            ranges[free] = []
        ranges[free].append((first, n, capacity))

    for length in sorted(histogram, reverse=True):
        rank, n = 0, histogram[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                free = rooms[at]
                first, count, capacity = ranges[free].pop()
                if not ranges[free]:
                    del ranges[free]
                    rooms.pop(at)
            else:
                capacity = min(
                    (c for c in sizes if c >= length), key=lambda c: ((c + bin_cost) / max(1, min(c, left)), c)
                )
                free, first, count = capacity, bins, -(-n // (capacity // length))
                if len(sizes) > 1 and count > 1:  # later bins may do with another size
                    count = max(1, min(count, left // (2 * capacity)))
                bins += count
            each = free // length
            full = min(count, n // each)
            if full:
                placements.append((length, rank, first, each, capacity - free))
                put(free - each * length, first, full, capacity)
                rank, n, left = rank + full * each, n - full * each, left - full * each * length
            if full < count and n and n < each:
                placements.append((length, rank, first + full, each, capacity - free))
                put(free - n * length, first + full, 1, capacity)
                left, full, n = left - n * length, full + 1, 0
            put(free, first + full, count - full, capacity)
    done.extend((first, c - free) for free, rs in ranges.items() for first, _, c in rs)
    return Plan(
        np.array(sorted(placements), np.int64).reshape(-1, 5), np.array(sorted(done), np.int64).reshape(-1, 2)
    )


def place(plan: Plan, capacities, lengths, ranks):
    """Bin, offset in it, its downsized capacity and its content for pieces given by length and rank."""
    key = plan.placements[:, 0] * (1 << 44) + plan.placements[:, 1]
    row = plan.placements[np.searchsorted(key, lengths * (1 << 44) + ranks, "right") - 1]
    nth = ranks - row[:, 1]
    bins, offsets = row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * lengths
    content = plan.bins[np.searchsorted(plan.bins[:, 0], bins, "right") - 1, 1]
    sizes = np.array(sorted(capacities), np.int64)
    return bins, offsets, sizes[np.searchsorted(sizes, content)], content


def _word_counts(batches):
    apart = separators()
    for batch in batches:
        counts = [
            np.bincount(word_spans(data, offsets, apart)[2], minlength=len(offsets) - 1)
            for _, _, data, offsets in pieces(batch.column("text"))
        ]
        n = np.concatenate(counts) if counts else np.zeros(0)
        yield pa.record_batch([batch.column("doc_id"), pa.array(n.astype(np.int64))], names=["doc_id", "n_words"])


def token_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, length): words of the whole text plus one end mark."""
    counted = texts(docs).mapInArrow(_word_counts, "doc_id long, n_words long")
    return counted.select("doc_id", (F.col("n_words") + 1).alias("length"))


def pack(lengths: DataFrame, capacities=CAPACITIES, bin_cost: int = 64, seed: int = 5) -> DataFrame:
    """Pack rows (doc_id, length >= 1): one output row per piece, with bin_id, bin_offset, bin_capacity, bin_tokens."""
    largest = max(capacities)
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / largest).cast("int")))
    rows = stored(
        lengths.withColumn("piece", cut)
        .withColumn("n_tokens", F.least(F.lit(largest), F.col("length") - F.col("piece") * F.lit(largest)).cast("long"))
        .select("doc_id", "piece", "n_tokens")
        .withColumn("shuffle", seeded(seed, "doc_id", "piece"))
    )
    histogram = {r.n_tokens: r["count"] for r in rows.groupBy("n_tokens").count().collect()}  # at most `largest` rows
    plan = best_fit(histogram, capacities, bin_cost)
    shared = rows.sparkSession.sparkContext.broadcast((plan.placements, plan.bins))
    ranked = rank_within(rows, ["n_tokens"], "shuffle", ["doc_id", "piece"], sum(histogram.values()), "rank")

    def run(batches):
        placed = Plan(*shared.value)
        for batch in batches:
            found = place(placed, capacities, *(np.asarray(batch.column(c)) for c in ("n_tokens", "rank")))
            yield pa.record_batch(
                [*(batch.column(c) for c in ("doc_id", "piece", "n_tokens")), *map(pa.array, found)],
                names=["doc_id", "piece", "n_tokens", "bin_id", "bin_offset", "bin_capacity", "bin_tokens"],
            )

    return ranked.select("doc_id", "piece", "n_tokens", "rank").mapInArrow(
        run, "doc_id long, piece int, n_tokens long, bin_id long, bin_offset long, bin_capacity long, bin_tokens long"
    )
