"""Personal data: base spans against the plain patterns, disguises by planted cases, offsets by the source text."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placetrace.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def accepted(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        odd, even = digits[::-1][::2], digits[::-1][1::2]
        return 13 <= len(digits) <= 19 and (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0
    return True


def plain_spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text)
        if accepted(kind, m.group())
    ]


def base_spans(text):
    return [(s.kind, s.start, s.end) for s in pii.find_spans(text) if s.base]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1240.@+- (é\n", max_size=60) | st.from_regex("|".join(f"(?:{p})" for p in PLAIN.values()), fullmatch=True))
def test_base_spans_equal_the_plain_patterns(text):
    assert base_spans(text) == plain_spans(text)


DISGUISED = [
    ("write john.smith [at] example [dot] com now", "email", "john.smith [at] example [dot] com", "john.smith@example.com"),
    ("john(at)example(dot)com", "email", "john(at)example(dot)com", "john@example.com"),
    ("so JOHN AT EXAMPLE DOT COM", "email", "JOHN AT EXAMPLE DOT COM", "JOHN@EXAMPLE.COM"),
    ("mail j.doe at example.com!", "email", "j.doe at example.com", "j.doe@example.com"),
    ("john @ example . com", "email", "john @ example . com", "john@example.com"),
    ("to user_at_example_dot_com", "email", "user_at_example_dot_com", "user@example.com"),
    ("é ivan＠exаmple．com x", "email", "ivan＠exаmple．com", "ivan@example.com"),
    ("jo​hn@exam​ple.com", "email", "jo​hn@exam​ple.com", "john@example.com"),
    ("plus four four two zero seven nine four six zero nine five eight", "phone", None, "+442079460958"),
    ("tel +４４ ２０ ７９４６ ０９５８.", "phone", "+４４ ２０ ７９４６ ０９５８", "+44 20 7946 0958"),
    ("+1 (555) 123–4567 89", "phone", "+1 (555) 123–4567 89", "+1 (555) 123-4567 89"),
    ("one nine two dot one six eight dot one dot one", "ip", None, "192.168.1.1"),
    ("at 192 dot 168 dot 1 dot 20 now", "ip", "192 dot 168 dot 1 dot 20", "192.168.1.20"),
    ("10.0.0.١", "ip", "10.0.0.١", "10.0.0.1"),
    ("card four one one one one one one one one one one one one one one one ok", "card", None, "4111111111111111"),
    ("4l11-1111-1111-1111", "card", "4l11-1111-1111-1111", "4111-1111-1111-1111"),
    ("٤١١١ ١١١١ ١١١١ ١١١١", "card", "٤١١١ ١١١١ ١١١١ ١١١١", "4111 1111 1111 1111"),
    ("x = 4111 1111 1111 1111", "card", "4111 1111 1111 1111", "4111 1111 1111 1111"),
]


@pytest.mark.parametrize("text, kind, source, value", DISGUISED)
def test_disguises_map_back_to_the_source(text, kind, source, value):
    for head, tail in (("", ""), ("𝒳 “ü” ", ""), ("mixed 𝟘 é ", " and ﬁnal words.")):
        whole = head + text + tail
        spans = [s for s in pii.find_spans(whole) if s.kind == kind]
        assert [s.base for s in spans] == [False], whole
        found = spans[0]
        assert found.value == value
        if source is not None:
            assert whole[found.start : found.end] == source
        base, disguised = pii.signs(pa.array([whole]))
        assert disguised == [True]


def test_a_longer_address_is_added_to_its_base_span():
    spans = pii.find_spans("j@x.example [dot] com")
    assert [tuple(s)[:4] for s in spans] == [("email", 0, 11, True), ("email", 0, 21, False)]


CLEAN = [
    "we are at the dot in the road",
    "look at example.com for more",
    "of at thedenly. It was at noon. It ended",
    "one two three",
    "un un un point un",
    "4111 1111 1111 1112",
    "version 1.2.3 of 300.1.1.1",
    "call me at nine or ten",
    "Почта и дом",
]


@pytest.mark.parametrize("text", CLEAN)
def test_plain_words_stay_alone(text):
    assert pii.find_spans(text) == []


def test_digits_after_a_phone_do_not_lengthen_it():
    text = "+1 (848) 555-1373 Un an"
    assert [(s.start, s.end, s.base) for s in pii.find_spans(text)] == [(0, 17, True)]


@pytest.mark.parametrize("unit", ["a", "1", "+5 ", "1.", "@", "one ", "a@", "[ ", " ", "at ", "a-at-", "dot ", "_", "1 ", "\t", "x at "])
def test_long_runs_take_linear_time(unit):
    text = unit * (200_000 // len(unit))
    assert all(0 <= s.start < s.end <= len(text) for s in pii.find_spans(text))


def test_table_equals_single_texts(spark, documents, odd, nothing):
    for docs in (documents, odd):
        rows = docs.select("doc_id", "text").collect()
        found = pii.personal_data(docs).collect()
        mine = sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in found)
        assert mine == sorted((str(r.doc_id), [tuple(s) for s in pii.find_spans(r.text or "")]) for r in rows)
    assert pii.personal_data(nothing).collect() == []


def test_digest_columns(spark, documents):
    texts = {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
    rows = pii.digest(pii.personal_data(documents)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in pii.KINDS)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert any(r.n_phone for r in rows) and any(r.n_email for r in rows) and any(r.n_ip for r in rows)
