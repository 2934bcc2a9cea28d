"""Toxicity, quality, licence scan and language-model scoring."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placetrace.llm import licences, lm_score, quality, toxicity
from placetrace.llm.chunks import bucket_of, pressed, split_by
from placetrace.llm.tables import held_out
from placetrace.llm.textkit import BASE, Hasher, mix


def planted(spark, n=240):
    """Documents of which a third hold a made-up insult and a third are shouting junk."""
    random = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(random.choice(list("aeioumnrst"), 5)) for _ in range(60)]
        toxic = i % 3 == 0
        junk = i % 3 == 1
        if toxic:
            words[int(random.integers(60))] = "blargfen"
            words[int(random.integers(60))] = "blargfeno"
        if junk:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_toxicity_on_held_out_rows(spark):
    docs, labels = planted(spark)
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 30 and all(r.predicted == r.toxic for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxic_words_are_folded_and_exceptions_hold():
    lexicon = toxicity.Lexicon({"idiot": 5.0, "idiotwork ": 0.0, "trash ": 4.0, "trash can ": 0.0}, 1.0, -3.0)
    folded = {toxicity.fold(k, toxicity.folding()).strip() + (" " if k.endswith(" ") else ""): v
              for k, v in lexicon.weights.items()}
    made, table = toxicity.automaton(toxicity.Lexicon(folded)), toxicity.folding()
    hits = lambda text: toxicity.strength(text, table, made)[1]
    assert hits("You IDIOT, you") == hits("1d10t") == hits("іdiоt") == hits("id​iots") == 1
    assert hits("an idiotwork here") == 0 and hits("a trash can") == 0 and hits("trash it") == 1
    assert hits("nonidiot") == 0 and hits("") == 0


def test_longer_texts_weigh_less():
    made, table = toxicity.automaton(toxicity.Lexicon({"scum ": 4.0})), toxicity.folding()
    short = toxicity.strength("scum here", table, made)[0]
    assert short > toxicity.strength("scum " + "word " * 5000, table, made)[0] > 0


def test_quality_on_held_out_rows(spark):
    docs, labels = planted(spark)
    rows = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert len(rows) > 30 and right >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_isotonic_levels_pool_violators():
    x, y = np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1])
    knots, levels = quality.isotonic(x, y)
    assert (np.diff(levels) > 0).all() and np.isclose(np.interp(2.5, knots, levels), 0.5)


def test_held_out_rows_are_those_of_the_contract(spark):
    import zlib

    rows = spark.range(200).select(F.col("id").alias("doc_id"), held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_labels_change_nothing_for_held_out_training(spark):
    docs, labels = planted(spark)
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert a == b


@pytest.fixture(scope="module")
def background(documents):
    settings = licences.Settings()
    return licences.background_lines(documents, settings), settings


def scanned(text, model, known, settings):
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(data)])
    hits = licences.hits_of(data, offsets, model, known, settings, Hasher(lower=True), licences.word_table())[1]
    return [family for family, _ in hits.get(0, [])]


def test_look_alike_licences_are_told_apart(background):
    lines, settings = background
    model, known = licences.train(lines, settings), licences.Known(settings)
    prose = " ".join(" ".join(lines).split()[:250])
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    for text, family in {
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License": "lgpl",
        "it under the terms of the GNU Affero General Public License as published by the Foundation": "agpl",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "Licensed under CC BY-ND 4.0.": "cc-by-nd",
        "SPDX-License-Identifier: AGPL-3.0-only": "agpl",
        "SPDX-License-Identifier: EUPL-1.2": "eupl",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        f"{prose} {mit} {prose}": "mit",
        mit.replace("person ", "person\n"): "mit",
        "Licensed under the Apache License, Version 1.1.": "other",
        "This work is licensed under a Creative Commons Attribution Share Alike 4.0 License": "other",
        "SPDX-License-Identifier: Beerware": "other",
    }.items():
        assert scanned(text, model, known, settings) == [family], text
    assert scanned("a plain road to the public domain of words", model, known, settings) == []


@pytest.mark.parametrize("family", ["gpl", "cc-by-sa", "eupl"])
def test_families_that_were_never_seen_are_not_taken_for_known_ones(background, family):
    lines, settings = background
    rest = tuple(f for f in licences.TEMPLATES if f != family)
    model, known = licences.train(lines, settings, rest), licences.Known(settings, rest)
    found = [scanned(line, model, known, settings) for line in licences.lines_of(family)]
    assert all(f in ([], ["other"]) for f in found) and sum(f == ["other"] for f in found) >= 0.6 * len(found)


def test_licence_probabilities_are_calibrated(background):
    """Confidence of the best class against how often it is right, on copies kept apart."""
    lines, settings = background
    model, known = licences.train(lines, settings), licences.Known(settings)
    plain = [b for b in lines if b.strip() and not known.licence_like(licences.words_of(b.encode()))]
    _, _, (texts, labels) = licences.examples(plain, settings)
    p = licences.softmax(licences.logits(model, *licences._encoded(texts, settings)) / model.temperature)
    sure, right = p.max(1), p.argmax(1) == np.array(labels)
    bins = np.minimum((sure * 10).astype(int), 9)
    error = sum(abs(sure[bins == b].mean() - right[bins == b].mean()) * (bins == b).mean() for b in np.unique(bins))
    assert error < 0.05 and right.mean() > 0.9


def test_licence_scores_and_overlap_by_hand(background):
    """Class values from spelled words and pairs, and overlap from spelled pairs, one stretch at a time."""
    lines, settings = background
    model, known = licences.train(lines[:200], settings), licences.Known(settings)
    text = "Some Words here.\nLicensed under the (MIT) license, and\nmore words"
    data = np.frombuffer(text.encode(), np.uint8)
    found = licences.stretches(data, np.array([0, len(data)]), Hasher(lower=True), licences.word_table())
    words = licences.words_of(text.encode())
    assert len(found.codes) == len(words) and found.n_lines == 3
    value = licences.logits(model, *licences.buckets_of(found.codes, settings), found.first, found.last)
    for i, (first, last) in enumerate(zip(found.first.tolist(), found.last.tolist(), strict=True)):
        one = _encode_words(words[first:last], settings)
        total = sum((model.weights[b] for b in one), np.zeros(len(model.classes)))
        assert np.allclose(value[i], total / np.sqrt(max(1, len(one))) + model.bias)
    template = licences.pairs_of(licences.words_of(b"Licensed under the MIT license."))
    seen = {b"licensed under", b"under the", b"the mit", b"mit license", b"license and"}
    weight = {pair: known.weight[pair] for pair in template}
    assert known.overlap(seen, template) == pytest.approx(1.0)
    assert known.overlap({b"licensed under"}, template) == pytest.approx(weight[b"licensed under"] / sum(weight.values()))


def _encode_words(words, settings):
    codes = [int(licences.stretches(np.frombuffer(w, np.uint8), np.array([0, len(w)]), Hasher(lower=True), licences.word_table()).codes[0]) for w in words]
    with np.errstate(over="ignore"):
        pairs = [int(mix(np.array([a], np.uint64) * np.uint64(BASE) + np.uint64(b))[0]) for a, b in zip(codes, codes[1:])]
    return [(c >> 20) % settings.buckets for c in codes + pairs]


def test_licence_families_are_found(spark, documents):
    lines = [
        "Released under the MIT License.",
        "Licensed under the Apache License, Version 2.0.",
        "LICENSED UNDER CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 3.",
        "All rights reserved.",
        "A plain line about the licence of a driver and a public road.",
    ]
    rows = [(i, f"some words before it\n{line}\nand some after it") for i, line in enumerate(lines)]
    sample = documents.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(sample)
    found = {r.doc_id: r for r in licences.licence_scan(docs).where("doc_id < 100").collect()}
    expected = ["mit", "apache", "cc-by-nc", "gpl", "reserved", "none"]
    assert [found[i].licence for i in range(6)] == expected
    assert all(r.n_paragraphs == 3 for r in found.values())


def test_licence_scan_agrees_with_planted_lines(documents):
    told = re.compile("Released under the MIT License|Apache License, Version 2.0|CC BY-NC|GNU General Public|All rights reserved")
    rows = {r.doc_id: r.licence for r in licences.licence_scan(documents).collect()}
    for r in documents.collect():
        assert (rows[r.doc_id] != "none") == any(told.search(line) for line in r.text.split("\n")), r.doc_id


def brute_losses(rows, target, settings):
    words = {i: re.findall(r"[^\x20\t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for i, t in rows}
    count = Counter(w for ws in words.values() for w in ws)
    coded = {i: [w if count[w] >= settings.least_count else None for w in ws] for i, ws in words.items()}
    models = []
    for ids in (set(words), target):
        one = Counter(w for i in ids for w in coded[i])
        two = Counter((a, b) for i in ids for a, b in zip(["^", *coded[i]], coded[i], strict=False))
        one["^"] = len(ids)
        models.append((one, two))
    terms = sum(n >= settings.least_count for n in count.values())
    out = {}
    for i, ws in coded.items():
        losses = []
        for one, two in models:
            n = sum(one.values()) - one["^"]
            loss = 0.0
            for a, b in zip(["^", *ws], ws, strict=False):
                alone = (one[b] + settings.unigram_prior) / (n + settings.unigram_prior * (terms + 1))
                loss -= math.log((two[a, b] + settings.bigram_prior * alone) / (one[a] + settings.bigram_prior))
            losses.append(loss / len(ws) if ws else None)
        out[i] = losses
    return out


def test_lm_scores_equal_counts_by_hand(documents, labels):
    settings = lm_score.Settings(chunk_bytes=50000, bucket_bytes=20000)
    target = lm_score.good_documents(labels)
    ids = {r.doc_id for r in target.collect()}
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expected = brute_losses(rows, ids & {i for i, _ in rows}, settings)
    for r in lm_score.cross_entropy_difference(documents, target, settings).collect():
        background, wanted = expected[r.doc_id]
        assert math.isclose(r.background_loss, background, rel_tol=1e-9)
        assert math.isclose(r.target_loss, wanted, rel_tol=1e-9)
        assert math.isclose(r.score, wanted - background, rel_tol=1e-6, abs_tol=1e-9)


def test_lm_target_counts_all_labelled_documents(spark):
    """With every document in the target both models are one, however many documents there are."""
    text = F.concat_ws(" ", F.concat(F.lit("w"), F.col("id") % 50), F.concat(F.lit("x"), F.col("id") % 7))
    docs = spark.range(60000).select(F.col("id").alias("doc_id"), text.alias("text"))
    scores = lm_score.cross_entropy_difference(docs, docs.select("doc_id"))
    assert scores.where("score = 0").count() == 60000


def test_codes_travel_unchanged():
    codes = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 1000, dtype=np.uint64))
    assert (lm_score.unpacked_codes(lm_score.packed_codes(codes)) == codes).all()


def test_odd_rows(spark, odd, nothing, labels):
    marks = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for run in (
        lambda d: toxicity.toxicity(d, marks),
        lambda d: quality.quality(d, marks),
        licences.licence_scan,
        lambda d: lm_score.cross_entropy_difference(d, lm_score.good_documents(marks)),
    ):
        rows = run(odd).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect())
        assert run(nothing).collect() == []
    scores = lm_score.cross_entropy_difference(odd, lm_score.good_documents(marks))
    assert {r.n_tokens for r in scores.where("score is null").collect()} == {0}


def test_counts_above_32_bits_are_kept():
    codes = np.array([4, 8, 12], np.uint64)
    for counts, kind in (([5, 6, 7], np.uint32), ([5, 1 << 40, 7], np.uint64)):
        sums = np.array([counts, counts[::-1]]).astype(kind)
        sent = [{"bucket": int(b), "counts": pressed(sums[:, part])} for b, part in split_by(bucket_of(codes, 4), 4)]
        assert lm_score.returned(codes, sent, 4).tolist() == [counts, counts[::-1]]


def test_toxic_strength_equals_a_scan_of_all_places():
    """Every place of the folded text, the longest term that stands there, by plain search."""
    random = np.random.default_rng(6)
    table = toxicity.folding()
    terms = {"ab": 2.0, "aba ": 0.0, "abc": 3.5, "b ": 1.0, "cab ": 4.0, "ca": 0.5}
    made = toxicity.automaton(toxicity.Lexicon(terms, 1.0, -3.0))
    for _ in range(300):
        text = "".join(random.choice(list("abc  .1")) for _ in range(int(random.integers(0, 60))))
        folded, hits = toxicity.fold(text, table), []
        for at in range(len(folded)):
            here = [t for t in terms if folded.startswith(f" {t}", at)]
            if here and terms[max(here, key=len)] > 0:
                hits.append(terms[max(here, key=len)])
        total, n = toxicity.strength(text, table, made)
        assert n == len(hits)
        assert total == pytest.approx(sum(hits) / (1 + math.log1p(folded.count(" ") / 200)))


def test_quality_statistics_of_a_batch_equal_those_of_single_texts():
    random = np.random.default_rng(3)
    texts = ["", " ", "One line.\nTwo lines!", "THE the the", "a*# b! c", "é ü 12 3", "w " * 700]
    texts += ["".join(random.choice(list("abC. !1\n"), int(random.integers(0, 300)))) for _ in range(40)]
    column = pa.array(texts)
    together = quality._batch_statistics(column, Hasher())
    for i, text in enumerate(texts):
        alone = quality._batch_statistics(pa.array([text]), Hasher())[0]
        assert np.allclose(together[i], alone)
        words, n = text.split(), max(1, len(text.encode()))
        by_hand = {
            0: sum("A" <= c <= "Z" for c in text) / n, 3: sum("0" <= c <= "9" for c in text) / n,
            8: math.log1p(len(words)), 14: len(set(words)) / max(1, len(words)),
            11: sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)), 18: float(not words),
        }
        for k, value in by_hand.items():
            assert together[i, k] == pytest.approx(value), (text, k)


def test_isotonic_levels_equal_the_min_max_formula():
    random = np.random.default_rng(2)
    x, y = np.sort(random.random(60)), random.integers(0, 2, 60).astype(float)
    knots, levels = quality.isotonic(x, y)
    assert (np.diff(levels) > 0).all()
    best = [max(min(y[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    assert sorted(set(np.round(best, 9))) == sorted(set(np.round(levels, 9)))
