"""Importance resampling against plain counting, also with repeated scores, odd rows and other settings."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from placetrace.llm import resample

LOWER = {i: i + 32 for i in range(65, 91)}


def grams(text, longest=3):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def by_hand(docs, targets, percent=5):
    def count(texts):
        return Counter(zlib.crc32(g.encode()) % 10000 for t in texts for g in grams(t)[1])

    s, t = count(x for _, x in docs), count(targets)
    big_s, big_t = float(sum(s.values())), float(sum(t.values()))

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000.0) / ((s[b] + 1.0) * (big_t + 10000.0))))

    rows = []
    for doc_id, text in docs:
        words, features = grams(text)
        weight = sum(gain(zlib.crc32(g.encode()) % 10000) for g in features)
        name = "null" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"42:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(features), weight, score, len(words) >= 20))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    wanted = percent * len(fit) // 100
    ranked = [(*r[:4], i + 1 if i < wanted else None) for i, r in enumerate(fit)]
    return Counter(ranked + [(*r[:4], None) for r in rows if not r[4]])


def found(spark, docs, targets, **changes):
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    return Counter(tuple(r) for r in resample.resample(rows, target, resample.Settings(**changes)).collect())


def test_rows_equal_plain_counting(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    targets = [docs[3][1], docs[20][1], None, ""]
    assert found(spark, docs, targets) == by_hand(docs, targets)
    assert found(spark, docs, [], percent=60) == by_hand(docs, [], 60)


def test_ties_go_to_the_smaller_id_and_repeats_are_drawn_each(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = [(i % 40, text) for i in range(400)] + [(None, text)] * 30 + [(1, "short"), (2, None), (3, "")]
    assert found(spark, docs, ["w1 w2"], percent=33) == by_hand(docs, ["w1 w2"], 33)


def test_odd_and_no_rows(spark, odd, nothing, documents):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    mine = Counter(tuple(r) for r in resample.resample(odd, documents).collect())
    assert mine == by_hand(docs, [r.text for r in documents.select("text").collect()])
    assert resample.resample(nothing, documents).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aB1 é字-\x00\x7f", max_size=30), max_size=6))
def test_feature_codes_equal_crcs_of_the_spelled_features(texts):
    sizes = Counter()
    for n, (rows, codes, crcs) in enumerate(resample.features(pa.array(texts, pa.string()), 3), 1):
        sizes.update(zip([n] * len(rows), rows.tolist(), crcs[codes].tolist(), strict=True))
    expected = Counter(
        (g.count(" ") + 1, i, zlib.crc32(g.encode())) for i, t in enumerate(texts) for g in grams(t)[1]
    )
    assert sizes == expected


def test_joined_crcs():
    pairs = [(b"a" * i, b"bc" * j) for i in range(0, 40, 7) for j in (0, 1, 3, 300, 70000)]
    first = np.array([zlib.crc32(a) for a, _ in pairs], np.uint32)
    second = np.array([zlib.crc32(b) for _, b in pairs], np.uint32)
    sizes = np.array([len(b) for _, b in pairs])
    assert resample.joined_crc(first, second, sizes).tolist() == [zlib.crc32(a + b) for a, b in pairs]
