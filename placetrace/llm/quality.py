"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics (shares of letter cases, signs, repeated words, line and
word lengths, over the whole text and over its worst tenth) are standardised.
Random Fourier features approximate a Gaussian kernel on them; every partition
of the training sample sums its own normal equations, the sums are added, and a
ridge solution scores documents.  Scores are calibrated by isotonic regression
on a fourth of the sample that the ridge fit did not see.

Edge cases: a null or empty text has all statistics 0 and is scored like any
other; a null id is passed through and is never held out; repeated rows are
scored each; an empty table gives an empty result; other columns are ignored.
Without training labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.llm.tables import held_out, labelled_sample, texts
from placetrace.llm.textkit import Hasher, pieces, row_sums, separators, word_spans

BLOCK_WORDS = 64


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the training rows and ``partitions`` the summed equations."""

    sample: int = 20000
    partitions: int = 8
    features: int = 256
    width: float = 3.0
    ridge: float = 1e-3
    seed: int = 11


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray


def _class_tables():
    tables = np.zeros((8, 256), bool)
    tables[0, 65:91] = True  # capital letters
    tables[1, 97:123] = True  # small letters
    tables[2, 128:] = True  # bytes of other letters
    tables[3, 48:58] = True
    tables[4, [ord(c) for c in "!?"]] = True
    tables[5, [ord(c) for c in "*#$%&@^~<>{}[]\\/_=+"]] = True
    tables[6, ord("|")] = True
    tables[7, [ord(c) for c in ".,;:"]] = True
    return tables


def statistics(data, offsets, hasher):
    """One row of statistics per document."""
    n = len(offsets) - 1
    lengths = np.maximum(np.diff(offsets), 1)
    shares = [row_sums(t[data], offsets) / lengths for t in _class_tables()]
    starts, ends, rows = word_spans(data, offsets, separators())
    words = hasher.spans(hasher.running(data), starts, ends)
    sizes = np.bincount(rows, minlength=n)
    per = np.maximum(sizes, 1)
    width = (ends - starts).astype(float)
    mean_width = np.bincount(rows, width, n) / per
    spread = np.sqrt(np.maximum(np.bincount(rows, width * width, n) / per - mean_width**2, 0))
    same = np.zeros(len(words), bool)
    if len(words) > 1:
        same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    ended = np.zeros(len(words), bool)
    signs = np.isin(data[ends - 1], np.frombuffer(b"*#$%&!", np.uint8)) if len(words) else ended
    alone = (width == 1) & ~np.isin(data[starts], np.frombuffer(b"aAIiyYeEoO", np.uint8)) if len(words) else ended
    order = np.lexsort((words, rows))
    first = np.ones(len(words), bool)
    first[1:] = (words[order][1:] != words[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    distinct = np.bincount(rows[order][first], minlength=n)
    runs = np.flatnonzero(first)
    counts = np.diff(np.append(runs, len(words)))
    most = np.zeros(n)
    np.maximum.at(most, rows[order][runs], counts)
    # The worst block of words: documents that are junk in a part only.
    odd = (same | signs | alone).astype(float)
    if len(words):
        first_word = np.searchsorted(rows, np.arange(n))
        block = (np.arange(len(words)) - first_word[rows]) // BLOCK_WORDS
        most_blocks = int(block.max()) + 1
        key = rows * most_blocks + block
        ids, inverse = np.unique(key, return_inverse=True)
        share = np.bincount(inverse, odd) / np.bincount(inverse)
        worst = np.zeros(n)
        np.maximum.at(worst, ids // most_blocks, share)
    else:
        worst = np.zeros(n)
    lines = row_sums(data == 10, offsets)
    columns = [
        *shares,
        np.log1p(sizes),
        mean_width,
        spread,
        np.bincount(rows, same.astype(float), n) / per,
        np.bincount(rows, signs.astype(float), n) / per,
        np.bincount(rows, alone.astype(float), n) / per,
        distinct / per,
        most / per,
        worst,
        np.log1p(lines) / np.log1p(per),
        (sizes == 0).astype(float),
    ]
    return np.stack(columns, 1)


N_STATISTICS = 19


def _batch_statistics(column, hasher):
    made = [statistics(data, offsets, hasher) for _, _, data, offsets in pieces(column)]
    return np.concatenate(made) if made else np.zeros((0, N_STATISTICS))


def _training_rows(batches):
    """mapInArrow: statistics with the label and the part (0: ridge, 1: calibration)."""
    hasher = Hasher()
    for batch in batches:
        x = _batch_statistics(batch.column("text"), hasher)
        arrays = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATISTICS).cast(pa.list_(pa.float64()))
        yield pa.record_batch([batch.column("label"), batch.column("part"), arrays], names=["label", "part", "x"])


def _matrix(column):
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), float).reshape(len(flat), N_STATISTICS)


def features(model, x):
    z = np.clip((x - model.mean) / model.scale, -6, 6) @ model.directions + model.phases
    return np.concatenate([np.cos(z) * np.sqrt(2 / z.shape[1]), np.ones((len(x), 1))], 1)


def _normal_equations(model):
    """mapInArrow: the sums of one partition as one row."""

    def run(batches):
        size = len(model.phases) + 1
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = features(model, _matrix(batch.column("x")))
            left += z.T @ z
            right += z.T @ np.asarray(batch.column("label"), float)
        yield pa.record_batch([[left.tobytes()], [right.tobytes()]], names=["gram", "moment"])

    return run


def isotonic(x, y):
    """Knots and non-decreasing levels by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks = []
    for at, value in zip(x[order], y[order], strict=True):
        blocks.append([value, 1.0, at])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            value, weight, place = blocks.pop()
            total = blocks[-1][1] + weight
            place = (blocks[-1][2] * blocks[-1][1] + place * weight) / total
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + value * weight) / total, total, place]
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    part = F.when(F.pmod(F.xxhash64("doc_id", F.lit(settings.seed)), F.lit(4)) == 0, 1).otherwise(0)
    rows = (
        labelled_sample(docs, labels, "quality", settings.sample)
        .select("text", "label", part.alias("part"))
        .mapInArrow(_training_rows, "label int, part int, x array<double>")
        .repartition(settings.partitions)
        .persist()
    )
    try:
        moments = rows.groupBy("label").count().collect()
        if {r.label for r in moments} != {0, 1}:
            return None
        at = [F.avg(F.col("x")[i]) for i in range(N_STATISTICS)]
        sd = [F.stddev_pop(F.col("x")[i]) for i in range(N_STATISTICS)]
        values = np.array(rows.agg(*[c.alias(f"c{i}") for i, c in enumerate([*at, *sd])]).first(), float)
        random = np.random.default_rng(settings.seed)
        scale = values[N_STATISTICS:]
        model = Model(
            values[:N_STATISTICS],
            np.where(scale > 1e-9, scale, 1.0),
            random.standard_normal((N_STATISTICS, settings.features)) / settings.width,
            random.uniform(0, 2 * np.pi, settings.features),
            np.zeros(settings.features + 1),
            np.array([0.0, 1.0]),
            np.array([0.0, 1.0]),
        )
        sums = rows.where("part = 0").mapInArrow(_normal_equations(model), "gram binary, moment binary").collect()
        size = settings.features + 1
        gram = sum(np.frombuffer(r.gram).reshape(size, size) for r in sums)
        moment = sum(np.frombuffer(r.moment) for r in sums)
        n = max(gram[-1, -1], 1.0)
        model.weights = np.linalg.solve(gram + settings.ridge * n * np.eye(size), moment)
        held = rows.where("part = 1").select("label", "x").toPandas()
        if held.label.nunique() == 2:
            raw = features(model, np.array(held.x.tolist())) @ model.weights
            model.knots, model.levels = isotonic(raw, held.label.to_numpy(float))
        return model
    finally:
        rows.unpersist()


def calibrated(model, raw):
    """Isotonic level, with a small share of the raw score that orders equal levels."""
    level = np.interp(raw, model.knots, model.levels)
    return np.clip(0.98 * level + 0.02 * np.clip(raw, 0, 1), 0, 1)


def _scores(model):
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            x = _batch_statistics(batch.column("text"), hasher)
            scores = calibrated(model, features(model, x) @ model.weights) if model else np.full(len(x), 0.5)
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for every row."""
    return texts(docs).mapInArrow(_scores(model), "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold=0.7, settings: Settings = Settings()) -> DataFrame:
    """Every row with doc_id, held_out, score and predicted."""
    return score(docs, fit(docs, labels, settings)).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
    )


def _accepted(model, threshold):
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            x = _batch_statistics(batch.column("text"), hasher)
            scores = calibrated(model, features(model, x) @ model.weights) if model else np.ones(len(x))
            yield batch.filter(pa.array(scores >= threshold))

    return run


def accepted(docs: DataFrame, model: Model | None, threshold=0.7) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; without a model, all of them."""
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(_accepted(model, threshold), docs.schema)
