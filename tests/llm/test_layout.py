"""Sharding, packing, the pipeline and the registered queries."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from placetrace.llm import packing, sharding
from placetrace.llm.queries import ORACLE, QUERIES
from placetrace.llm.ranks import rank_within, seeded


def test_shards_are_even_and_match_the_mixture(spark):
    rows = [(i, f"text {i % 50}", "hot" if i % 3 else f"s{i % 11}") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sharding.shards(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    counts = Counter(r.shard for r in found)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    slots, mixture = defaultdict(list), defaultdict(Counter)
    for r in found:
        slots[r.shard].append(r.slot)
        mixture[r.source][r.shard] += 1
        text = f"text {r.doc_id % 50}".encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = Counter(r.source for r in found)
    for source, shards in mixture.items():
        assert all(abs(shards[s] - total[source] / 24) <= len(total) for s in range(24)), source


def test_shards_of_odd_rows(odd, nothing):
    rows = sharding.shards(odd).collect()
    assert len(rows) == odd.count() and max(r.slot for r in rows) == 0
    assert {r.size for r in rows if r.doc_id in (3, 4)} == {8}
    assert sharding.shards(nothing).collect() == []


def test_ranks_in_buckets_equal_a_window(spark, monkeypatch):
    monkeypatch.setattr("placetrace.llm.ranks.ROWS_IN_BUCKET", 7)
    monkeypatch.setattr("placetrace.llm.ranks.BUCKETS_IN_BLOCK", 3)
    rows = spark.range(900).select("id", F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("g"))
    rows = rows.withColumn("u", seeded(1, "id"))
    found = rank_within(rows, ["g"], "u", ["id"], 900, "rank").collect()
    for g in "ab":
        mine = sorted((r.u, r.id, r["rank"]) for r in found if r.g == g)
        assert [x[2] for x in mine] == list(range(len(mine)))


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_fills_bins_without_gaps(seed):
    random = np.random.default_rng(seed)
    lengths = np.minimum(8192, np.maximum(1, random.lognormal(5, 1.6, 1500).astype(int)))
    lengths[: 500] = lengths[0]  # one hot length
    histogram = {int(k): int(n) for k, n in Counter(lengths.tolist()).items()}
    ls = np.repeat(list(histogram), list(histogram.values()))
    ranks = np.concatenate([np.arange(n) for n in histogram.values()])
    plan = packing.best_fit(histogram)
    bins, offsets, capacity, content = packing.place(plan, packing.CAPACITIES, ls, ranks)
    for b in range(bins.max() + 1):
        inside = np.flatnonzero(bins == b)
        order = inside[np.argsort(offsets[inside])]
        assert (offsets[order] == np.concatenate(([0], np.cumsum(ls[order])[:-1]))).all()
        assert ls[inside].sum() == content[inside[0]] <= capacity[inside[0]]
        smaller = [c for c in packing.CAPACITIES if c >= content[inside[0]]]
        assert capacity[inside[0]] == min(smaller)
    assert ls.sum() / sum(capacity[np.unique(bins, return_index=True)[1]]) > 0.97


@pytest.mark.parametrize("seed", range(4))
def test_one_size_packs_as_best_fit_piece_by_piece(seed):
    """With one permitted size the plan opens as many bins, filled alike, as best fit does a piece at a time."""
    random = np.random.default_rng(seed)
    lengths = sorted((int(x) for x in np.clip(random.lognormal(4, 1, 400), 1, 512)), reverse=True)
    rooms = []
    for length in lengths:
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(512 - length)
    histogram = {int(k): int(n) for k, n in Counter(lengths).items()}
    plan = packing.best_fit(histogram, (512,))
    ls = np.repeat(list(histogram), list(histogram.values()))
    ranks = np.concatenate([np.arange(n) for n in histogram.values()])
    bins = packing.place(plan, (512,), ls, ranks)[0]
    content = np.bincount(bins, ls)
    assert sorted(512 - content) == sorted(rooms)


def test_packing_keeps_every_token(documents, odd, nothing):
    for docs in (documents, odd):
        rows = packing.pack(packing.token_lengths(docs), capacities=(256, 512, 1024)).collect()
        lengths = {(r.doc_id,): len((r.text or "").split()) + 1 for r in docs.collect() if r.doc_id is not None}
        times = Counter((r.doc_id,) for r in docs.collect())
        tokens = Counter()
        for r in rows:
            tokens[(r.doc_id,)] += r.n_tokens
            assert 1 <= r.n_tokens and r.bin_offset + r.n_tokens <= r.bin_tokens <= r.bin_capacity
        assert all(tokens[k] == n * times[k] for k, n in lengths.items() if k != (8,))
    assert packing.pack(packing.token_lengths(nothing)).collect() == []


def test_pipeline_stages(spark, documents):
    docs, sizes = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == documents.columns, name
        docs = corpus_pipeline.stored(docs)
        sizes.append(docs.count())
    assert documents.count() > sizes[0] > sizes[1] >= sizes[2] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in last.select("doc_id").collect()} == kept


def test_pipeline_of_odd_and_no_rows(spark, odd, nothing):
    for docs, some in ((odd, True), (nothing, False)):
        before = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, "/root/testdata/sf0.001"))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == corpus_pipeline.COLUMNS and docs.count() <= before, name
                before = docs.count()
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert (None in ids) == some and len(ids) <= before


def test_pipeline_filters_by_row_and_not_by_id(spark):
    a, b = "one two three four five six seven", "alpha beta gamma delta epsilon zeta eta"
    docs = spark.createDataFrame(
        [(3, b, "en", "s", 1), (5, b, "en", "s", 1), (5, a, "en", "s", 1), (None, b, "en", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    left = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("3", b), ("5", a), ("None", b)]


def test_one_query_for_each_operator():
    numbers = {int(name[2:].split("_")[0]) for name in QUERIES if name != "pipeline"}
    assert numbers == set(range(1, 14)) and "pipeline" in QUERIES and set(ORACLE) <= set(QUERIES)
