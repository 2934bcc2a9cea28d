"""Exact removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that also starts earlier (in a
smaller doc_id, or earlier in the same document) covers it.

1. Documents are gathered into chunks of a few MB, written once.
2. Every window of ``length`` bytes has an anchor: the least of the hashes of its
   ``gram``-byte strings, the same in every copy of the window.  Anchors that occur
   once in the corpus rule out their windows; only others go on.  Counts are
   combined per chunk before they are shuffled.
3. For each remaining anchor the bytes of its windows form a context.  Contexts
   that are equal, byte for byte, are reduced to the first, in the chunk and in the
   bin of their anchor.  An anchor with very many different contexts is cut into
   single windows, binned by a hash of their own bytes, so no bin holds an unbounded
   group.  Hashes only bring strings together: what is removed was compared.
4. A bin splits its different contexts into shards, builds the transform of each,
   and merges them by iterative interleave refinement: the interleave sorted by
   the first j bytes is dealt stably by the two bytes before each suffix, which
   sorts it by j + 2 bytes.  Only suffixes that lead to a whole window take part, and
   one that is alone in its group leaves, as what precedes it is alone as well.
   Groups that still hold together after ``length`` bytes
   are the repeated intervals; all but the earliest of each are removed.  Shards
   are sorted once; merging never sorts suffixes again.
5. Removed windows return to the chunks, which emit the kept bytes.

Texts travel compressed.  Edge cases: a null text is an empty one; documents
shorter than ``length`` keep all; a null doc_id comes after all others; rows that
share an id are ordered by their place in the chunk table; an empty table gives
an empty result; other columns are carried in ``rest`` and cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.llm.chunks import LAST, TEXT_LEVEL, bucket_of, chunked, packed_rows, pressed, rows_of, split_by, unpressed
from placetrace.llm.graph import by_key
from placetrace.llm.tables import stored
from placetrace.llm.textkit import BASE, byte_codes, mix, power_tables

@dataclass(frozen=True)
class Settings:
    length: int = 100
    gram: int = 32
    chunk_bytes: int = 4 << 20
    bin_bytes: int = 6 << 20
    most_contexts: int = 20000
    shard_bytes: int = 1 << 19

    @property
    def grams(self):
        return self.length - self.gram + 1


class Chunk:
    """Bytes of a chunk with its anchors: place, window starts it stands for, hash, hash of its context."""

    def __init__(self, row, settings):
        self.number = row["chunk"]
        self.ids = unpressed(row["ids"], np.int64)
        self.offsets = unpressed(row["offsets"], np.int64)
        self.data = unpressed(row["data"], np.uint8)
        self.settings = settings

    def scan(self):
        x, k, q, w = self.data, self.settings.length, self.settings.gram, self.settings.grams
        empty = np.zeros(0, np.int64)
        self.place = self.low = self.high = empty
        self.code = self.context = empty.view(np.uint64)
        if len(x) < k:
            return self
        up, down = power_tables(len(x))
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(byte_codes()[x] * up[:-1], out=total[1:])
        self.total, self.down = total, down
        gram = mix((total[q:] - total[:-q]) * down[: len(x) - q + 1])
        bits = max(20, int(len(x)).bit_length())
        mask = np.uint64((1 << bits) - 1)
        key = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64)
        best, done = key, 1
        while done * 2 <= w:  # least of 2, 4, 8 ... keys
            best = np.minimum(best[:-done], best[done:])
            done *= 2
        if done < w:
            best = np.minimum(best[: len(key) - w + 1], best[w - done :][: len(key) - w + 1])
        valid = np.zeros(len(best) + 1, np.int64)
        first, last = self.offsets[:-1], self.offsets[1:] - k + 1
        some = last > first
        np.add.at(valid, first[some], 1)
        np.add.at(valid, last[some], -1)
        starts = np.flatnonzero(np.cumsum(valid)[:-1])
        if not len(starts):
            return self
        where = (best[starts] & mask).astype(np.int64)
        cut = np.ones(len(starts), bool)
        cut[1:] = (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(starts)) - 1
        self.place, self.low, self.high = where[begin], starts[begin], starts[end]
        self.code = gram[self.place]
        self.context = self.hashes(self.low, self.high + k) ^ (self.place - self.low).astype(np.uint64)
        return self

    def hashes(self, starts, ends):
        return mix((self.total[ends] - self.total[starts]) * self.down[starts])

    def documents(self, starts):
        return np.searchsorted(self.offsets, starts, "right") - 1


def _distinct_anchors(chunk):
    """Anchor hashes of a chunk, sorted, and the number of different contexts of each."""
    order = np.lexsort((chunk.context, chunk.code))
    code, context = chunk.code[order], chunk.context[order]
    new_code = np.ones(len(code), bool)
    new_code[1:] = code[1:] != code[:-1]
    new_context = new_code.copy()
    new_context[1:] |= context[1:] != context[:-1]
    first = np.flatnonzero(new_code)
    times = np.diff(np.append(first, len(code)))
    contexts = np.add.reduceat(new_context.astype(np.int64), first) if len(first) else first
    return code[first], times, contexts


def _anchors(settings, buckets):
    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                chunk = Chunk(row, settings).scan()
                code, times, contexts = _distinct_anchors(chunk)
                rows = []
                for bucket, part in split_by(bucket_of(code, buckets), buckets):
                    counts = np.minimum(contexts[part], 65535).astype(np.uint16)
                    payload = [code[part].tobytes(), pressed(counts, np.minimum(times[part], 2).astype(np.uint16))]
                    rows.append((bucket, chunk.number, *payload))
                if rows:
                    yield packed_rows(rows, ("bucket", "chunk", "codes", "counts"))

    return run


def _flags(settings):
    """mapInArrow over buckets: for each chunk whose anchors repeat, 1 (repeated) or 2 (many contexts)."""

    def run(batches):
        for group in by_key(batches, "bucket"):
            rows = group.to_pylist()
            codes = [np.frombuffer(r["codes"], np.uint64) for r in rows]
            counts = [unpressed(r["counts"], np.uint16).reshape(2, -1).astype(np.int64) for r in rows]
            every, inverse = np.unique(np.concatenate(codes), return_inverse=True)
            contexts = np.bincount(inverse, np.concatenate([c[0] for c in counts]), len(every))
            times = np.bincount(inverse, np.concatenate([c[1] for c in counts]), len(every))
            flag = np.where(times < 2, 0, np.where(contexts > settings.most_contexts, 2, 1)).astype(np.uint8)[inverse]
            out, at = [], 0
            for row, code in zip(rows, codes, strict=True):
                mine = flag[at : at + len(code)]
                at += len(code)
                if mine.any():
                    out.append((row["chunk"], row["bucket"], pressed(mine)))
            if out:
                yield packed_rows(out, ("chunk", "bucket", "flags"))

    return run


def _pieces(values, starts, ends):
    """Concatenation of values[start:end] for each pair."""
    n = ends - starts
    at = np.concatenate(([0], np.cumsum(n)))
    index = np.repeat(starts - at[:-1], n) + np.arange(at[-1])
    return values[index]


def _same_as_before(data, at, size, alike, step=1 << 20):
    """Of the strings (at, size) marked ``alike`` by hash, those whose bytes equal those of the string before.

    About ``step`` bytes are compared at a time.
    """
    i = np.flatnonzero(alike)
    i = i[size[i] == size[i - 1]]
    out = np.zeros(len(alike), bool)
    ends = np.cumsum(size[i])
    for some in np.split(i, np.unique(np.searchsorted(ends, np.arange(step, ends[-1], step)) + 1) if len(i) else []):
        if len(some):
            n = size[some]
            first = np.cumsum(n) - n
            index = np.arange(n.sum(), dtype=np.int32) + np.repeat((at[some] - first).astype(np.int32), n)
            other = data[index] != data[index - np.repeat((at[some] - at[some - 1]).astype(np.int32), n)]
            out[some] = ~np.logical_or.reduceat(other, first)
    return out


def _contexts(settings, buckets, bins):
    """mapInArrow: contexts for the bins (bin >= 0), and windows whose copy the chunk itself holds (bin -1)."""

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                chunk = Chunk(row, settings).scan()
                code = _distinct_anchors(chunk)[0]
                flag = np.zeros(len(code), np.uint8)
                sent = {r["bucket"]: unpressed(r["flags"], np.uint8) for r in row["sent"]}
                for bucket, part in split_by(bucket_of(code, buckets), buckets):
                    if bucket in sent:
                        flag[part] = sent[bucket]
                mine = flag[np.searchsorted(code, chunk.code)] if len(code) else flag
                rows = _context_rows(chunk, mine, settings, bins)
                if rows:
                    yield packed_rows(rows, ("bin", "chunk", "payload"))

    return run


def _context_rows(chunk, flag, settings, bins):
    low, high, key, key2 = (v[flag == 1] for v in (chunk.low, chunk.high, chunk.code, chunk.context))
    wide = flag == 2
    if wide.any():  # single windows, keyed by their bytes
        starts = _pieces(np.arange(len(chunk.data)), chunk.low[wide], chunk.high[wide] + 1)
        code = chunk.hashes(starts, starts + settings.length)
        low, high = np.append(low, starts), np.append(high, starts)
        key, key2 = np.append(key, code), np.append(key2, code)
    if not len(low):
        return []
    doc = chunk.documents(low)
    order = np.lexsort((low, doc, chunk.ids[doc], key2, key))
    low, high, key, key2, doc = (v[order] for v in (low, high, key, key2, doc))
    again = np.zeros(len(low), bool)
    again[1:] = (key[1:] == key[:-1]) & (key2[1:] == key2[:-1])
    again = _same_as_before(chunk.data, low, high - low + settings.length, again)
    rows = []
    at = chunk.offsets[doc]
    if again.any():
        rows.append((-1, chunk.number, pressed(np.stack([doc[again], (low - at)[again], (high - at)[again]]))))
    first = np.flatnonzero(~again)
    for number, part in split_by(bucket_of(key[first], bins), bins):
        i = first[part]
        ends = high[i] + settings.length
        meta = np.stack([key[i].view(np.int64), key2[i].view(np.int64), chunk.ids[doc[i]], doc[i], low[i] - at[i], ends - low[i]])
        body = _pieces(chunk.data, low[i], ends)
        rows.append((number, chunk.number, pressed(np.array([len(i)], np.int64), meta, body, level=TEXT_LEVEL)))
    return rows


class Transform:
    """Rotations of a shard's strings, sorted by ``depth`` bytes.

    Of each the ``step`` bytes before it (``symbols``), the place in the order of the
    rotation that starts with them (``back``), and whether a window of ``depth`` bytes
    of the string ends before it (``whole``).
    """

    def __init__(self, data, starts, depth, step):
        n = np.diff(np.append(starts, len(data)))
        begin, size = np.repeat(starts, n), np.repeat(n, n)
        inside = np.arange(len(data)) - begin

        def ahead(by):
            return begin + (inside + by) % size

        rank, done = data.astype(np.uint32), 1
        for _ in range(2):  # four bytes
            rank = (rank << np.uint32(8 * done)) | rank[ahead(done)]
            done *= 2
        while True:
            order = np.argsort(rank)
            new = np.ones(len(rank), np.int64)
            new[1:] = rank[order][1:] != rank[order][:-1]
            if done >= depth or new.all():
                break
            dense = np.empty(len(rank), np.int64)
            dense[order] = np.cumsum(new) - 1
            by = min(done, depth - done)
            rank, done = (dense << 32) | dense[ahead(by)], done + by
        self.places = order
        before = np.zeros(len(data), np.uint16)
        for j in range(step, 0, -1):
            before = (before << 8) | data[ahead(-j)]
        self.symbols = before[order]
        place = np.empty(len(data), np.int64)
        place[order] = np.arange(len(data))
        self.back = place[ahead(-step)[order]]
        self.whole = ((size >= depth) & ((inside >= depth) | (inside == 0)))[order]


def interleave(shards, depth, step):
    """Merge shard transforms: (place, group) of the repeated windows of ``depth`` bytes.

    A place counts through the transforms, one after the other.  Each round deals the
    interleave stably by the symbols before its rotations; groups split where the symbol
    or the former group differs, and a rotation alone in its group is not merged further.
    """
    first = np.cumsum([0, *[len(s.symbols) for s in shards[:-1]]])
    symbols = np.concatenate([s.symbols for s in shards])
    back = np.concatenate([s.back + a for s, a in zip(shards, first, strict=True)])
    place = np.flatnonzero(np.concatenate([s.whole for s in shards]))
    group = np.zeros(len(place), np.int32)
    for _ in range(depth // step):
        merged = symbols[place]
        order = np.argsort(merged, kind="stable")
        dealt, group = merged[order], group[order]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (dealt[1:] != dealt[:-1]) | (group[1:] != group[:-1])
        several = ~(new[:-1] & new[1:])
        group = np.cumsum(new[:-1], dtype=np.int32)[several]
        place = back[place[order[several]]]
    return place, group


def repeated(data, starts, settings):
    """(place, group) of the windows of ``length`` bytes that occur again in other strings or places."""
    k = settings.length
    step = 2 if k % 2 == 0 else 1
    cuts = np.searchsorted(starts, np.arange(0, len(data), max(settings.shard_bytes, len(data) // 200 + 1)))
    if len(starts) > 1:  # at least two shards
        cuts = np.unique(np.append(cuts, len(starts) // 2))
    cuts = np.unique(np.append(cuts, [0, len(starts)]))
    shards, places = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first, last = starts[a], starts[b] if b < len(starts) else len(data)
        shard = Transform(data[first:last], starts[a:b] - first, k, step)
        shards.append(shard)
        places.append(shard.places + first)
    place, group = interleave(shards, k, step)
    return np.concatenate(places)[place], group


def _runs(values):
    """First and last of each run of neighbouring ascending whole numbers."""
    cut = np.flatnonzero(np.diff(values) != 1) + 1
    return values[np.append(0, cut)], values[np.append(cut, len(values)) - 1]


def _binned(settings):
    """mapInArrow over bins: windows of each chunk that start earlier elsewhere."""

    def run(batches):
        for group in by_key(batches, "bin"):
            metas, bodies, chunks = [], [], []
            for row in group.to_pylist():
                raw = zstandard.decompress(row["payload"])
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                metas.append(np.frombuffer(raw, np.int64, 6 * n, 8).reshape(6, n))
                bodies.append(np.frombuffer(raw, np.uint8, -1, 8 + 48 * n))
                chunks.append(np.full(n, row["chunk"]))
            key, key2, ids, doc, low, size = np.concatenate(metas, 1)
            body, chunk = np.concatenate(bodies), np.concatenate(chunks)
            at = np.concatenate(([0], np.cumsum(size)[:-1]))
            order = np.lexsort((low, doc, chunk, ids, key2, key))
            key, key2, ids, doc, low, size, chunk, at = (v[order] for v in (key, key2, ids, doc, low, size, chunk, at))
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            again = np.zeros(len(key), bool)
            again[1:] = ~new_key[1:] & (key2[1:] == key2[:-1])
            again = _same_as_before(body, at, size, again)
            owner = np.cumsum(new_key) - 1
            kinds = np.bincount(owner, ~again)
            several = (kinds[owner] > 1) & ~again
            gone = [np.stack([chunk[again], doc[again], low[again], low[again] + size[again] - settings.length])]
            i = np.flatnonzero(several)
            if len(i):
                data = _pieces(body, at[i], at[i] + size[i])
                starts = np.concatenate(([0], np.cumsum(size[i])[:-1]))
                place, same = repeated(data, starts, settings)
                which = np.searchsorted(starts, place, "right") - 1
                c = i[which]
                window = low[c] + place - starts[which]
                rank = np.lexsort((window, doc[c], chunk[c], ids[c], same))
                c, window, same = c[rank], window[rank], same[rank]
                # The earliest of a group stays, and so do further sights of the same place.
                first = np.ones(len(same), bool)
                first[1:] = same[1:] != same[:-1]
                lead = np.maximum.accumulate(np.where(first, np.arange(len(same)), 0))
                later = (chunk[c] != chunk[c[lead]]) | (doc[c] != doc[c[lead]]) | (window != window[lead])
                gone.append(np.stack([chunk[c][later], doc[c][later], window[later], window[later]]))
            gone = np.concatenate(gone, 1)
            rows = []
            for number in np.unique(gone[0]):
                mine = gone[1:, gone[0] == number]
                rows.append((int(number), pressed(mine)))
            if rows:
                yield packed_rows(rows, ("chunk", "payload"))

    return run


def _kept(settings, whole_characters):
    """mapInArrow: the documents of a chunk without their removed bytes."""

    def run(batches):
        for batch in batches:
            for i, row in enumerate(rows_of(batch.select(["chunk", "ids", "offsets", "data", "gone"]))):
                chunk = Chunk(row, settings)
                cover = np.zeros(len(chunk.data) + 1, np.int64)
                for payload in row["gone"] or ():
                    doc, low, high = unpressed(payload, np.int64).reshape(3, -1)
                    np.add.at(cover, chunk.offsets[doc] + low, 1)
                    np.add.at(cover, chunk.offsets[doc] + high + settings.length, -1)
                removed = np.cumsum(cover[:-1]) > 0
                if whole_characters and removed.any():  # a character goes if all its bytes do
                    start = np.flatnonzero((chunk.data & 0xC0) != 0x80)
                    start = start if len(start) and start[0] == 0 else np.append(0, start)
                    whole = np.logical_and.reduceat(removed, start)
                    removed = np.repeat(whole, np.diff(np.append(start, len(removed))))
                begins = removed.copy()
                begins[1:] &= ~removed[:-1]
                edges = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
                begins[edges] = removed[edges]
                sums = [np.concatenate(([0], np.cumsum(v))) for v in (removed, begins)]
                counts = [s[chunk.offsets[1:]] - s[chunk.offsets[:-1]] for s in sums]
                kept = chunk.data[~removed]
                left = (chunk.offsets - sums[0][chunk.offsets]).astype(np.int64)
                texts = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(chunk.ids), [None, pa.py_buffer(left), pa.py_buffer(kept)]
                )
                rest = batch.column("rest")[i].values
                values = [
                    pa.array(chunk.ids, mask=chunk.ids == LAST),
                    pa.array(np.diff(chunk.offsets)),
                    pa.array(counts[0]),
                    pa.array(counts[1]),
                    texts,
                    rest,
                ]
                yield pa.record_batch(
                    values, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "rest"]
                )

    return run


def suffix_dedup(docs: DataFrame, settings: Settings = Settings(), whole_characters=False) -> DataFrame:
    """Every row with doc_id, n_bytes, n_removed, n_spans, kept (binary) and rest (the other columns)."""
    chunks = chunked(docs, settings.chunk_bytes)
    kind = chunks.schema["rest"].dataType.elementType.simpleString()
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bins = 8 + int(total // settings.bin_bytes)
    body = chunks.select("chunk", "ids", "offsets", "data")
    anchors = body.mapInArrow(_anchors(settings, bins), "bucket long, chunk long, codes binary, counts binary")
    flags = (
        anchors.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_flags(settings), "chunk long, bucket long, flags binary")
    )
    sent = stored(flags.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "flags")).alias("sent")))
    found = stored(
        body.join(sent.hint("merge"), "chunk").mapInArrow(_contexts(settings, bins, bins), "bin long, chunk long, payload binary")
    )
    merged = (
        found.where("bin >= 0")
        .repartition("bin")
        .sortWithinPartitions("bin")
        .mapInArrow(_binned(settings), "chunk long, payload binary")
    )
    windows = found.where("bin < 0").select("chunk", "payload").unionByName(merged)
    gone = stored(windows.groupBy("chunk").agg(F.collect_list("payload").alias("gone")))
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, rest {kind}"
    return chunks.join(gone.hint("merge"), "chunk", "left").mapInArrow(_kept(settings, whole_characters), schema)
