"""Importance resampling of documents towards the distribution of target texts.

Texts are hashed n-gram counts.  An Arrow batch is lower-cased, split and
flattened into words by kernels and the words are dictionary-encoded; pairs of
neighbouring dictionary indices are the two-word features and pairs of such a
pair and the next word the three-word ones, each encoded again.  So a CRC is made
once per distinct feature of a piece, from the CRCs of its two parts, and buckets
and gains are taken by index.  One pass counts the buckets of documents and
targets, a second one sums the gains of each document.

The draw adds Gumbel noise from a hash of the id, which makes the best scores a
sample without replacement in proportion to exp(weight / 1000).  It is exact at
any size: a histogram of bounded length finds where the draw ends, and only rows
above are sorted, over ranges.

Edge cases: null and empty texts have no features and a weight of 0; a null
doc_id is hashed as ``null`` and comes last among ties; repeated rows are drawn
each for itself; an empty table gives no rows, and without target texts the gains
compare with an even distribution; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.llm.tables import stored, texts
from placetrace.llm.textkit import pieces

APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE_BYTES = 4 << 20


@dataclass(frozen=True)
class Settings:
    words: int = 3
    buckets: int = 10_000
    percent: int = 5
    least_words: int = 20
    seed: int = 42


@lru_cache(1)
def _byte_step() -> np.ndarray:
    """Images of the 32 bits under the CRC of one zero byte."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        bits = (bits >> np.uint32(1)) ^ np.where(bits & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return bits


def _apply(images, values):
    out = np.zeros(len(values), np.uint32)
    for k in range(32):
        out ^= np.where((values >> np.uint32(k)) & np.uint32(1), images[k], np.uint32(0))
    return out


@lru_cache(4096)
def _skip(length: int) -> np.ndarray:
    """Four tables of 256 entries that carry a CRC over ``length`` further bytes."""
    images, step = np.uint32(1) << np.arange(32, dtype=np.uint32), _byte_step()
    while length:
        if length & 1:
            images = _apply(step, images)
        step, length = _apply(step, step), length >> 1
    bytes_ = np.arange(256, dtype=np.uint32)
    return np.stack([_apply(images, bytes_ << np.uint32(8 * k)) for k in range(4)])


def joined_crc(first, second, lengths):
    """CRCs of first + second from the CRCs of both and the byte lengths of second."""
    sizes, code = np.unique(lengths, return_inverse=True)
    tables = np.stack([_skip(int(n)) for n in sizes]) if len(sizes) else np.zeros((1, 4, 256), np.uint32)
    out = second.copy()
    for k in range(4):
        out ^= tables[code, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def word_codes(column):
    """(row of each word, dictionary index of each word, distinct words) of a string column."""
    lists = pc.split_pattern_regex(pc.ascii_lower(column.fill_null("")), pattern=APART)
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists)
    filled = pc.not_equal(words, "")
    coded = words.filter(filled).dictionary_encode()
    return rows.filter(filled).to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def features(column, longest):
    """For each length: (row of each feature, its index into the CRCs, CRCs of the distinct features)."""
    rows, words, distinct = word_codes(column)
    spelled = distinct.cast(pa.binary()).to_pylist()
    crc = np.fromiter(map(zlib.crc32, spelled), np.uint32, len(spelled))
    length = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
    after = joined_crc(np.full(len(crc), zlib.crc32(b" "), np.uint32), crc, length - 1)
    found = [(rows, words, crc)]
    codes, crcs = words, crc
    for n in range(2, longest + 1):
        count = max(0, len(words) - n + 1)
        whole = rows[:count] == rows[n - 1 :][:count]
        pairs = codes[:count] * max(1, len(spelled)) + words[n - 1 :][:count]
        coded = pa.array(pairs[whole]).dictionary_encode()
        pair = coded.dictionary.to_numpy()
        left, right = pair // max(1, len(spelled)), pair % max(1, len(spelled))
        crcs = joined_crc(crcs[left], after[right], length[right])
        codes = np.zeros(count, np.int64)  # positions whose run would leave the row are never used again
        codes[whole] = coded.indices.to_numpy()
        found.append((rows[:count][whole], codes[whole], crcs))
    return found


def _pieces(batch):
    column = batch.column("text")
    for first, last, _, _ in pieces(column, PIECE_BYTES):
        yield first, last, column.slice(first, last - first)


def bucket_counts(rows: DataFrame, settings: Settings) -> DataFrame:
    """(bucket, n) of all features of column ``text``; a task sends one row for each of its buckets."""

    def run(batches):
        total = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for _, _, part in _pieces(batch):
                for _, codes, crcs in features(part, settings.words):
                    held = np.bincount(codes, minlength=len(crcs))
                    np.add.at(total, crcs % np.uint32(settings.buckets), held)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = rows.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: DataFrame, docs: DataFrame, settings: Settings) -> np.ndarray:
    """The gain of every bucket; two tables of at most ``buckets`` rows come to the driver."""

    def counts(rows):
        out = np.zeros(settings.buckets)
        for row in bucket_counts(rows, settings).collect():
            out[row.bucket] = row.n
        return out

    t, s = counts(target), counts(docs)
    size = float(settings.buckets)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, settings: Settings) -> DataFrame:
    """(doc_id, n_features, weight) of every row."""

    def run(batches):
        for batch in batches:
            n_features = np.zeros(batch.num_rows, np.int64)
            weight = np.zeros(batch.num_rows, np.int64)
            for first, last, part in _pieces(batch):
                for rows, codes, crcs in features(part, settings.words):
                    if not len(rows):
                        continue
                    value = gain[crcs % np.uint32(settings.buckets)].take(codes)
                    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                    weight[first + rows[starts]] += np.add.reduceat(value, starts)
                    n_features[first:last] += np.bincount(rows, minlength=last - first)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n_features), pa.array(weight)],
                names=["doc_id", "n_features", "weight"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_features long, weight long")


def noisy(rows: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``score``: the weight and Gumbel noise in thousandths from a hash of the id."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), name).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise)


def _level():
    """A coarse, never falling function of the score with at most some 17,000 values."""
    score = F.col("score").cast("double")
    return (F.signum(score) * F.floor(200 * F.log1p(F.abs(score)))).cast("long")


def draw(scored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``rank`` to the ``percent`` best of the rows with enough words; null for the others."""
    least = sum(max(0, settings.least_words - k) for k in range(settings.words))
    rows = scored.withColumn("level", F.when(F.col("n_features") >= least, _level()))
    levels = rows.where("level is not null").groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()
    wanted = settings.percent * sum(r.n for r in levels) // 100
    lowest, above = None, 0
    for row in sorted(levels, key=lambda r: -r.level):
        if above >= wanted:
            break
        lowest, above = row.level, above + row.n
    columns = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    nobody = rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    if lowest is None:
        return nobody
    near = F.coalesce(F.col("level") >= lowest, F.lit(False))
    # The last key parts rows that are equal in all the others, so that no range is hot.
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("tie")]
    ranged = rows.where(near).select(*columns, F.monotonically_increasing_id().alias("tie")).orderBy(*order)
    placed = stored(
        ranged.select(
            *columns,
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
        )
    )
    sizes = {r.part: r.n for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, before = [], 0
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    starts = F.broadcast(placed.sparkSession.createDataFrame(starts, "part int, start long"))  # a row for each task
    rank = F.col("start") + F.col("at") + 1
    drawn = placed.join(starts, "part").select(*columns, F.when(rank <= wanted, rank).alias("rank"))
    return drawn.unionByName(nobody.where(~near))


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row of ``docs`` with doc_id, n_features, weight, score and rank, weighed against ``target``."""
    gain = gains(target, docs, settings)
    return draw(stored(noisy(weighed(docs, gain, settings), settings)), settings)
