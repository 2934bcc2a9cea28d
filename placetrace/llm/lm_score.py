"""Language-model scoring by cross-entropy difference of two matched n-gram models.

Target and background model are bigram models with the same vocabulary, order
and smoothing: the target counts all labelled good documents, the background all
documents.  The vocabulary is every word that occurs often enough
in the corpus; all other words are one symbol.  A token's probability mixes its
bigram with its unigram (Dirichlet smoothing).  A document's score is the mean
over its tokens of target loss minus background loss; lower is more target-like.

Counts cover all documents: each chunk sends its distinct words, then its
distinct pairs of vocabulary words, with counts, and gets the corpus counts back.

Edge cases: a null or empty text has no tokens and null losses and score; null
ids and repeated rows are scored each; without labels the target model is
uniform; an empty table gives an empty result; other columns are ignored.  Words
and pairs are told apart by 48-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.llm.chunks import LAST, bucket_of, chunked, packed_rows, pressed, rows_of, split_by, unpressed
from placetrace.llm.graph import by_key
from placetrace.llm.tables import held_out, stored, texts
from placetrace.llm.textkit import BASE, Hasher, mix, separators, word_spans

MASK = np.uint64((1 << 48) - 1)
OTHER, START = np.uint64(1), np.uint64(2)
TOTALS = "terms long, background long, target long, other_background long, other_target long"
SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


@dataclass(frozen=True)
class Settings:
    least_count: int = 3
    unigram_prior: float = 0.5
    bigram_prior: float = 20.0
    chunk_bytes: int = 4 << 20
    bucket_bytes: int = 32 << 20


def packed_codes(codes):
    """Sorted codes as differences in byte planes, of which the upper ones are mostly zero."""
    return pressed(np.ascontiguousarray(np.diff(codes, prepend=np.uint64(0))).view(np.uint8).reshape(-1, 8).T)


def unpacked_codes(value):
    planes = unpressed(value, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


class Words:
    """Word codes of a chunk with their documents, and which documents are in the target."""

    def __init__(self, row, hasher, apart):
        data, self.offsets = unpressed(row["data"], np.uint8), unpressed(row["offsets"], np.int64)
        starts, ends, self.rows = word_spans(data, self.offsets, apart)
        self.codes = (hasher.spans(hasher.running(data), starts, ends) & MASK) | np.uint64(4)
        self.target = np.zeros(len(self.offsets) - 1, bool)
        self.target[row["places"] or []] = True

    def counted(self, codes, rows):
        every, inverse = np.unique(codes, return_inverse=True)
        background = np.bincount(inverse, minlength=len(every))
        target = np.bincount(inverse, self.target[rows], len(every)) if len(every) else background
        return every, background.astype(np.uint32), target.astype(np.uint32), inverse

    def vocabulary(self, sent, buckets):
        """Codes with rare words as OTHER, and corpus counts of each word."""
        every, _, _, inverse = self.counted(self.codes, self.rows)
        counts = returned(every, sent, buckets)
        known = counts[0] > 0
        return np.where(known[inverse], self.codes, OTHER), counts[:, inverse]

    def pairs(self, words):
        before = np.empty_like(words)
        before[1:] = words[:-1]
        first = np.ones(len(words), bool)
        first[1:] = self.rows[1:] != self.rows[:-1]
        before[first] = START
        return mix(before * np.uint64(BASE) + words) & MASK, first


def returned(codes, sent, buckets):
    """Corpus counts (background, target) in the order of ``codes``; 0 where none came back."""
    counts = np.zeros((2, len(codes)), np.int64)
    answers = {r["bucket"]: r["counts"] for r in sent or ()}
    for bucket, part in split_by(bucket_of(codes, buckets), buckets):
        if bucket in answers:
            sent_back = unpressed(answers[bucket], np.uint8)
            wide = len(sent_back) == 16 * len(part)  # counts above 32 bits come in 64
            counts[:, part] = sent_back.view(np.uint64 if wide else np.uint32).reshape(2, -1)
    return counts


def _sent(chunk, counted, buckets):
    codes, background, target, _ = counted
    rows = [
        (bucket, chunk, packed_codes(codes[part]), pressed(background[part], target[part]))
        for bucket, part in split_by(bucket_of(codes, buckets), buckets)
    ]
    return packed_rows(rows, ("bucket", "chunk", "codes", "counts")) if rows else None


def _word_counts(buckets):
    def run(batches):
        hasher, apart = Hasher(lower=True), separators()
        for batch in batches:
            for row in rows_of(batch):
                words = Words(row, hasher, apart)
                out = _sent(row["chunk"], words.counted(words.codes, words.rows), buckets)
                if out is not None:
                    yield out

    return run


def _pair_counts(word_buckets, buckets):
    def run(batches):
        hasher, apart = Hasher(lower=True), separators()
        for batch in batches:
            for row in rows_of(batch):
                words = Words(row, hasher, apart)
                pairs, _ = words.pairs(words.vocabulary(row["words"], word_buckets)[0])
                out = _sent(row["chunk"], words.counted(pairs, words.rows), buckets)
                if out is not None:
                    yield out

    return run


def _summed(least):
    """mapInArrow over buckets: corpus counts for each chunk, 0 below ``least``, and one row of totals."""

    def run(batches):
        for group in by_key(batches, "bucket"):
            rows = group.to_pylist()
            codes = [unpacked_codes(r["codes"]) for r in rows]
            counts = [unpressed(r["counts"], np.uint32).reshape(2, -1) for r in rows]
            every, inverse = np.unique(np.concatenate(codes), return_inverse=True)
            sums = np.stack([np.bincount(inverse, np.concatenate([c[i] for c in counts])) for i in (0, 1)])
            known = sums[0] >= least
            totals = [int(known.sum()), *(int(s[known].sum()) for s in sums), *(int(s[~known].sum()) for s in sums)]
            sums = np.where(known, sums, 0)
            sums = sums.astype(np.uint32 if sums.max(initial=0) < 2**32 else np.uint64)
            chunk, bucket, payload, at = [None], [rows[0]["bucket"]], [None], 0
            for row, code in zip(rows, codes, strict=True):
                chunk.append(row["chunk"])
                bucket.append(row["bucket"])
                payload.append(pressed(sums[:, inverse[at : at + len(code)]]))
                at += len(code)
            none = [None] * (len(chunk) - 1)
            columns = [pa.array(chunk, pa.int64()), pa.array(bucket, pa.int64()), pa.array(payload, pa.binary())]
            columns += [pa.array([t, *none], pa.int64()) for t in totals]
            names = ["chunk", "bucket", "counts", "terms", "background", "target", "other_background", "other_target"]
            yield pa.record_batch(columns, names=names)

    return run


def _losses(settings, word_buckets, buckets, totals):
    def run(batches):
        hasher, apart = Hasher(lower=True), separators()
        for batch in batches:
            for row in rows_of(batch):
                words = Words(row, hasher, apart)
                codes, unigrams = words.vocabulary(row["words"], word_buckets)
                pairs, first = words.pairs(codes)
                every, inverse = np.unique(pairs, return_inverse=True)
                both = returned(every, row["pairs"], buckets)[:, inverse]
                n = len(words.offsets) - 1
                tokens = np.bincount(words.rows, minlength=n)
                losses = []
                for m in (0, 1):
                    known, other = totals["known"][m], totals["other"][m]
                    one = np.where(codes == OTHER, other, unigrams[m])
                    alone = (one + settings.unigram_prior) / (
                        known + other + settings.unigram_prior * (totals["terms"] + 1)
                    )
                    before = np.empty_like(one)
                    before[1:] = one[:-1]
                    before[first] = totals["documents"][m]
                    p = (both[m] + settings.bigram_prior * alone) / (before + settings.bigram_prior)
                    losses.append(np.bincount(words.rows, -np.log(p), n))
                background, target = (np.divide(x, tokens, np.full(n, np.nan), where=tokens > 0) for x in losses)
                ids, empty = unpressed(row["ids"], np.int64), tokens == 0
                columns = [pa.array(ids, mask=ids == LAST), pa.array(tokens)]
                columns += [pa.array(x, mask=empty) for x in (target, background, target - background)]
                yield pa.record_batch(
                    columns, names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
                )

    return run


def _places(batches):
    """mapInArrow: the place in its chunk of every document with an id."""
    for batch in batches:
        for row in rows_of(batch):
            ids = unpressed(row["ids"], np.int64)
            places = np.flatnonzero(ids != LAST)
            columns = [np.full(len(places), row["chunk"]), places.astype(np.int32), ids[places]]
            yield pa.record_batch([pa.array(c) for c in columns], names=["chunk", "place", "doc_id"])


def _exchange(sent, least):
    """Corpus counts per chunk, stored, and their totals."""
    summed = stored(
        sent.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_summed(least), f"chunk long, bucket long, counts binary, {TOTALS}")
    )
    back = summed.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts")).alias("back"))
    names = ("terms", "background", "target", "other_background", "other_target")
    totals = summed.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in names]).first()
    return back, dict(zip(names, totals, strict=True))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row with doc_id, n_tokens, target_loss, background_loss and score.

    ``target`` has the doc_ids of the target documents, of any number: they are
    merged with the doc_ids of the chunks, so neither they nor texts are sent along.
    """
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    chunks = chunked(texts(docs), settings.chunk_bytes)
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    placed = chunks.select("chunk", "ids").mapInArrow(_places, "chunk long, place int, doc_id long")
    placed = placed.join(ids.hint("merge"), "doc_id")
    places = stored(placed.groupBy("chunk").agg(F.collect_list("place").alias("places")))
    n_all = chunks.agg(F.sum(F.size("rest"))).first()[0]
    n_target = places.agg(F.sum(F.size("places"))).first()[0]
    buckets = 8 + int(size // settings.bucket_bytes)
    kind = "bucket long, chunk long, codes binary, counts binary"
    body = chunks.select("chunk", "ids", "offsets", "data").join(places.hint("merge"), "chunk", "left")
    words, totals = _exchange(body.mapInArrow(_word_counts(buckets), kind), settings.least_count)
    words = stored(words.withColumnRenamed("back", "words"))
    with_words = body.join(words, "chunk", "left")
    pairs, _ = _exchange(with_words.mapInArrow(_pair_counts(buckets, buckets), kind), 1)
    known = {
        "terms": totals["terms"],
        "known": (totals["background"], totals["target"]),
        "other": (totals["other_background"], totals["other_target"]),
        "documents": (n_all or 0, n_target or 0),
    }
    complete = with_words.join(pairs.withColumnRenamed("back", "pairs"), "chunk", "left")
    return complete.mapInArrow(_losses(settings, buckets, buckets, known), SCHEMA)


def good_documents(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled good and not toxic, outside the held-out part."""
    return labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & ~held_out()).select("doc_id")
