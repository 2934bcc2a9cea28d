"""Near-duplicate texts and vectors, repeated passages, contamination."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from placetrace.llm import decontaminate, near_text, near_vectors, suffix_dedup
from placetrace.llm.chunks import chunked, pressed, unpressed
from placetrace.llm.graph import components


class Groups:
    def __init__(self, ids):
        self.of = {i: i for i in ids}

    def find(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def shingles(text, n=3):
    words = re.findall(r"[^\x20\t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return runs or ({tuple(words)} if words else set())


def brute_near(rows, n=3, least=85, over=100):
    sets = {i: shingles(t, n) for i, t in rows}
    groups = Groups(sets)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if shared and over * shared >= least * (len(sets[a]) + len(sets[b]) - shared):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in ids}


def copies(seed, n=120, length=60):
    """A base text and copies with up to eight words changed, some exact, and unrelated texts."""
    random = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(length)]
    rows = []
    for i in range(n):
        if i % 4 == 3:
            words = [f"u{i}x{j}" for j in range(int(random.integers(0, length)))]
        else:
            words = list(base)
            for at in random.integers(0, length, int(random.integers(0, 8))):
                words[at] = f"c{random.integers(0, 4)}"
        rows.append((i, " ".join(words)))
    return rows


SPLIT = near_text.Settings(node_rows=20, unit_rows=16, levels=3)


@pytest.mark.parametrize("settings", [near_text.Settings(), SPLIT], ids=["usual", "every group split"])
def test_near_duplicates_equal_brute_force(spark, settings):
    rows = copies(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_near(rows)
    for r in near_text.near_duplicates(docs, settings).collect():
        assert (r.n_shingles, r.component_id) == expected[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_the_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for n, least in ((3, 85), (5, 80)):
        expected = brute_near(rows, n, least)
        found = near_text.near_duplicates(documents, near_text.Settings(words=n, least=least)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_near_duplicates_of_odd_rows(odd, nothing):
    rows = near_text.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].component_id == by[2].component_id == 1 and by[1].kept and not by[2].kept
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[4].kept
    assert by[7].n_shingles == 1
    assert all(r.component_id is None and not r.kept for r in rows if r.doc_id is None)
    assert near_text.near_duplicates(nothing).collect() == []


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = ("one two three four five six", "alpha beta gamma delta epsilon zeta", "red green blue pink grey black")
    rows = [(3, b), (5, b), (5, a), (9, a), (11, c), (None, a)]
    found = near_text.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {
        (3, 3, True), (5, 3, False), (9, 3, False), (11, 11, True), (None, None, False)}


def test_surplus_rows_are_judged_by_their_own_text(spark):
    a, b = "one two three four five six", "alpha beta gamma delta epsilon zeta"
    docs = spark.createDataFrame([(3, b), (5, b), (5, a), (7, "x y")], "doc_id long, text string")
    gone = near_text.surplus(docs)
    left = docs.withColumn("text_hash", F.xxhash64("text")).join(gone, ["doc_id", "text_hash"], "left_anti")
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(3, b), (5, a), (7, "x y")]


def test_recall_of_crowded_nodes(spark):
    """Texts that share boilerplate, in pairs of near copies: nodes are crowded and must branch, and pairs are found."""
    random = np.random.default_rng(8)
    rows = []
    for i in range(400):
        # Two thirds of the words are common to all, so every picked common token leads to a crowded node.
        own = [f"o{i}x{j}" for j in range(30)]
        text = [f"c{j}" for j in range(60)] + own
        other = list(text)
        other[int(random.integers(60, 90))] = f"n{i}"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    settings = near_text.Settings(node_rows=16, leaders=4, unit_rows=64)
    found = near_text.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), settings).collect()
    joined = {r.doc_id: r.component_id for r in found}
    together = sum(joined[2 * i] == joined[2 * i + 1] for i in range(400))
    apart = sum(joined[2 * i] == joined[2 * i + 2] for i in range(399))
    assert together >= 0.99 * 400 and apart == 0


@pytest.mark.parametrize("seed", range(3))
def test_walked_sets_equal_all_pairs(seed):
    random = np.random.default_rng(seed)
    tokens = random.integers(0, 3, (150, 16)).astype(np.uint32)
    tokens[50:90] = tokens[0]
    tokens[50:90, 0] = np.arange(40)
    groups = Groups(range(150))
    for i in range(150):
        for j in range(i):
            if (tokens[i] == tokens[j]).sum() >= 11:
                groups.join(i, j)
    mine = Groups(range(150))
    for x, y in near_text.alike_pairs(tokens, 11):
        mine.join(x, y)
    assert [mine.find(i) for i in range(150)] == [groups.find(i) for i in range(150)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def brute_suffix(rows, k=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - k + 1):
            window = data[at : at + k]
            if window in seen:
                gone[at : at + k] = True
            seen.add(window)
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(data) else 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def suffix_rows(docs, settings):
    found = suffix_dedup.suffix_dedup(docs, settings).withColumn("hash", F.sha2("kept", 256))
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.hash) for r in found.collect()}


@pytest.mark.parametrize(
    "settings",
    [
        suffix_dedup.Settings(chunk_bytes=20000, bin_bytes=10000, shard_bytes=3000),
        suffix_dedup.Settings(chunk_bytes=20000, bin_bytes=50000, most_contexts=1),
    ],
    ids=["many shards", "all anchors cut into windows"],
)
def test_repeated_passages_equal_brute_force(documents, settings):
    docs = documents.where("doc_id < 120")
    assert suffix_rows(docs, settings) == brute_suffix([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("k", [40, 41])
def test_periods_overlaps_and_shared_passages(spark, k):
    random = np.random.default_rng(k)
    passage = "".join(random.choice(list("abcdefg "), 90))
    rows = [(0, "ab" * 100), (1, "x" * 39), (2, "x" * 200), (3, None), (4, "")]
    for i in range(5, 40):
        left, right = ("".join(random.choice(list("abcd "), int(random.integers(0, 60)))) for _ in range(2))
        start = int(random.integers(0, 30))
        rows.append((i, left + passage[start : start + int(random.integers(30, 60))] + right))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    settings = suffix_dedup.Settings(length=k, gram=16, chunk_bytes=500, bin_bytes=2000, shard_bytes=400)
    assert suffix_rows(docs, settings) == brute_suffix(rows, k)


def test_suffix_dedup_of_odd_rows(odd, nothing):
    found = suffix_dedup.suffix_dedup(odd, whole_characters=True)
    rows = found.select("doc_id", "n_bytes", "n_removed", F.decode("kept", "UTF-8").alias("t"), "rest.label").collect()
    assert len(rows) == odd.count()
    first = next(r for r in rows if r.doc_id == 1)
    assert 0 < first.n_removed < first.n_bytes and first.label == 1  # its own period repeats
    later = [r for r in rows if r.doc_id == 2 or (r.doc_id is None and r.n_bytes)]
    assert len(later) == 3 and all(r.n_removed == r.n_bytes and r.t == "" for r in later)
    assert suffix_dedup.suffix_dedup(nothing).collect() == []


def brute_vectors(rows, threshold=0.95):
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    groups, links = Groups([i for i, _ in rows]), {i: 0 for i, _ in rows}
    for a, x in good.items():
        for b, y in good.items():
            if a < b and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                groups.join(a, b)
                links[a] += 1
                links[b] += 1
    return {i: (links[i], groups.find(i)) for i, _ in rows}


def test_vector_links_equal_brute_force(spark):
    random = np.random.default_rng(5)
    rows = [(i, random.standard_normal(16).round(3).tolist()) for i in range(300)]
    for i in range(300, 420):  # one crowded group, with exact copies
        v = np.array(rows[7][1]) + random.standard_normal(16) * 0.05 * (i % 3)
        rows.append((i, v.round(3).tolist()))
    for i in range(420, 460):  # pairs
        rows.append((i, (np.array(rows[i - 400][1]) * 2 + 0.1).tolist()))
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16)]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, unit int")
    settings = near_vectors.Settings(block=32, neighbours=6, enlarged=12)
    expected = brute_vectors(rows)
    for r in near_vectors.near_vectors(vectors, settings).collect():
        assert (r.n_links, r.component_id) == expected[r.vec_id], r.vec_id
        assert r.kept == (r.vec_id == r.component_id)


def test_tight_groups_that_fill_all_lists_are_linked(spark):
    """Two groups, 0.999 inside and 0.96 across: the lists of each are full of its own members."""
    random = np.random.default_rng(11)
    first = np.eye(64)[0]
    second = 0.96 * first + np.sqrt(1 - 0.96**2) * np.eye(64)[1]
    x = np.repeat([first, second], 300, axis=0) + np.r_[random.standard_normal((600, 64))] * 0.03 / 8
    apart = random.standard_normal((400, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([apart, x]))]
    units = np.array([v for _, v in rows])
    units /= np.sqrt((units * units).sum(axis=1))[:, None]
    links = (units @ units.T >= 0.95).sum(axis=1) - 1
    assert (links[400:] > 300).all() and (links[:400] == 0).all()
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in near_vectors.near_vectors(vectors).collect():
        assert r.component_id == min(r.vec_id, 400) and r.n_links == links[r.vec_id], r.vec_id


def test_missed_links_are_found_by_the_audit(spark):
    """A search too weak for its recall: the audit sees pairs of which it found nothing, and all rows are compared."""
    random = np.random.default_rng(12)
    x = random.standard_normal((100, 32))
    y = x / np.sqrt((x * x).sum(axis=1))[:, None] + random.standard_normal((100, 32)) * 0.28 / np.sqrt(32)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = brute_vectors(rows)
    settings = near_vectors.Settings(block=2, codes=1, neighbours=2, enlarged=4, searches=1)
    found = near_vectors.near_vectors(vectors, settings).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == expected
    units = [(i, (np.array(v) / np.sqrt(np.dot(v, v))).tobytes()) for i, v in rows]
    units = spark.createDataFrame(units, "rep long, unit binary")
    alone = units.select(F.col("rep").alias("node"), F.col("rep").alias("root"))
    small = near_vectors.Settings(audit_bytes=32 * 8 * 100, audited=10**6)
    recall, missed = near_vectors.audit(units, alone, 32, small, 1)
    pairs = {tuple(sorted(r)) for r in missed.collect()}
    assert recall == 0.0 and 2 * len(pairs) == sum(n for n, _ in expected.values()) > 50


def test_components_of_no_edges_take_no_rounds(spark):
    """Loops and nulls are no edges; without others nothing is settled in rounds."""
    edges = spark.createDataFrame([(3, 3), (None, 1), (2, None)], "a long, b long")
    found = components(edges, rounds=0)
    assert found.columns == ["node", "root"] and found.collect() == []


def test_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert near_vectors.near_vectors(spark.createDataFrame([], kind)).collect() == []
    rows = near_vectors.near_vectors(spark.createDataFrame([(1, None), (None, [1.0, 2.0])], kind)).collect()
    assert {(r.vec_id, r.n_links, r.kept) for r in rows} == {(1, 0, True), (None, 0, False)}


def edits(a, b):
    """Least edit distance of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[j - 1] + 1))
    return min(row)


def folded_text(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return bytes(decontaminate.folded(data, np.array([0, len(data)]))[0]).strip()


def test_contamination_equals_alignment_everywhere(spark):
    random = np.random.default_rng(9)
    letters = list("abcdefghij  ")
    items = [(i, "".join(random.choice(letters, int(random.integers(90, 160))))) for i in range(8)]
    rows = []
    for i in range(60):
        text = list("".join(random.choice(letters, int(random.integers(0, 200)))))
        if i % 3:
            passage = list(items[i % 8][1])
            for _ in range(int(random.integers(0, 12))):
                at, kind = int(random.integers(0, len(passage))), int(random.integers(0, 3))
                passage[at : at + (kind > 0)] = list(random.choice(letters, int(kind < 2)))
            text[len(text) // 2 : len(text) // 2] = passage
        rows.append((i, "".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.distance for r in found.collect()}
    expected = {}
    for item_id, item in items:
        a = folded_text(item)
        budget = min(int(len(a) * 0.05), (len(a) - decontaminate.Q) // decontaminate.Q)
        for doc_id, text in rows:
            n = edits(a, folded_text(text))
            if n <= budget:
                expected[doc_id, item_id] = n
    assert got == expected and len(expected) > 15


def test_contamination_ignores_case_signs_and_blocks(spark, odd, nothing):
    passage = "The Quick brown fox, jumps over the lazy dog; and then it sleeps under the old oak tree."
    items = spark.createDataFrame([(1, passage), (2, "tiny Item"), (3, ""), (4, None), (None, passage)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"xx {passage.upper()} yy"), (2, "a tiny  item!"), (3, "tinyitem"), (None, passage), (5, None)],
        "doc_id long, text string",
    )
    for settings in (decontaminate.Settings(), decontaminate.Settings(block_bytes=60)):
        found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, settings).collect()}
        assert found == {(1, 1), (1, None), (2, 2), (None, 1), (None, None)}
    row = decontaminate.contaminated(docs, items).where("doc_id = 1 and item_id = 1").first()
    assert (row.start, row.distance) == (3, 0)
    assert decontaminate.contaminated(odd, items).collect() == []
    assert decontaminate.contaminated(nothing, items).collect() == []


def test_strings_that_only_share_hashes_stay(monkeypatch):
    """With every string under one hash, what is removed is still only what is equal."""
    data = np.frombuffer(b"abcdabcdabce", np.uint8)
    at, size = np.array([0, 4, 8]), np.array([4, 4, 4])
    same = suffix_dedup._same_as_before(data, at, size, np.array([False, True, True]))
    assert same.tolist() == [False, True, False]
    assert suffix_dedup._same_as_before(data, at, np.array([4, 3, 4]), np.array([False, True, True])).tolist() == [False, False, False]


def test_vectors_of_several_lengths_link_within_theirs(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.01]), (6, [5.0]), (7, [2.0]), (8, [1.0, 2.0, 3.0, 4.0])]
    rows += [(9, None), (10, []), (11, [0.0, 0.0]), (12, [None, 1.0])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (0, 8),
                     9: (0, 9), 10: (0, 10), 11: (0, 11), 12: (0, 12)}


def test_chunks_store_texts_smaller_than_what_is_compressed_for_speed(spark):
    words = "place trip stop rider dock lane north south early late winter summer".split()
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(words[j] for j in rng.integers(0, len(words), 400))) for i in range(100)]
    chunks = chunked(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 4 << 20).collect()
    texts = "".join(t for _, t in rows).encode()
    assert b"".join(unpressed(c["data"], np.uint8).tobytes() for c in chunks) == texts
    assert sum(len(c["data"]) for c in chunks) < 0.95 * len(pressed(np.frombuffer(texts, np.uint8)))


@pytest.mark.parametrize("seed", range(4))
def test_only_rotations_before_whole_windows_are_merged(seed):
    random, k = np.random.default_rng(seed), 10
    base = random.integers(0, 3, 60).astype(np.uint8)
    strings = [base[a : a + n] for a, n in zip(random.integers(0, 30, 9), random.integers(k, 30, 9), strict=True)]
    shards, seen, at = [], {}, 0
    for some in (strings[:4], strings[4:]):
        starts = np.cumsum([0, *[len(s) for s in some[:-1]]])
        shards.append(suffix_dedup.Transform(np.concatenate(some), starts, k, 2))
        assert shards[-1].whole.sum() == sum(len(s) - k + 1 for s in some)
        for s in some:
            for i in range(len(s) - k + 1):
                seen.setdefault(s[i : i + k].tobytes(), set()).add(at + i)
            at += len(s)
    place, group = suffix_dedup.interleave(shards, k, 2)
    places = np.concatenate([shards[0].places, shards[1].places + len(shards[0].places)])[place]
    found = {frozenset(places[group == g].tolist()) for g in np.unique(group)}
    assert found == {frozenset(v) for v in seen.values() if len(v) > 1}
