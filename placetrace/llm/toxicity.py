"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Texts are folded first: compatibility forms, lower case, homoglyphs of other
scripts, digit and sign substitutions, accents kept; ``l``, ``1``, ``|`` and
``!`` share one form.  The lexicon holds word beginnings and whole words whose
log odds between toxic and other labelled documents are high; word beginnings
catch inflected forms.  Exception phrases, given or learned (longer forms that
occur in harmless documents), cancel the terms they start with: at one place
only the longest match counts.  The weight of a document is divided by a slowly
growing function of its length and mapped to 0..1 by logistic regression.

Edge cases: a null or empty text has no match and gets the score of a text
without matches; a null id is passed through and is never held out; repeated
rows are scored each; an empty table gives an empty result; other columns are
ignored.  Without labels of both kinds the lexicon is empty.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.llm.tables import held_out, labelled_sample, stored, texts

# Look-alike letters of other scripts and signs used for letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ԁ": "d", "к": "k",
    "м": "m", "т": "t", "в": "b", "н": "h", "ѵ": "v", "ԝ": "w", "ј": "j", "ɡ": "g", "α": "a", "ο": "o", "ρ": "p",
    "ι": "i", "ν": "v", "τ": "t", "κ": "k", "ε": "e", "υ": "u", "χ": "x", "ı": "i", "ӏ": "i", "ո": "n", "ս": "u",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i"}
INVISIBLE = "­​‌‍⁠﻿"
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish", "scumble")


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit; scoring has none."""

    sample: int = 20000
    terms: int = 5000
    candidates: int = 50000
    least_documents: int = 5
    least_log_odds: float = 3.5
    prefixes: tuple[int, int] = (4, 12)
    exceptions: tuple[str, ...] = EXCEPTIONS


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = -3.0


def folding():
    """Translation of one character: letters folded, all else that is not a letter to a space."""
    table = {i: " " for i in range(128) if not chr(i).isalnum()}
    table |= {ord(k): v for k, v in SUBSTITUTES.items()}
    table |= {ord("|"): "i", ord("!"): "i"}
    table |= {ord(k): SUBSTITUTES.get(v, v) for k, v in LOOKALIKES.items()}
    return table | {ord(c): None for c in INVISIBLE}


def fold(text, table):
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {text.lower().translate(table)} "


def _words(text, table):
    return {w for w in fold(text or "", table).split() if len(w) >= 3}


def _term_counts(settings, wanted=None, extending=False):
    """mapInArrow: in how many documents of a batch each word beginning or whole word occurs.

    ``wanted`` restricts the count to its terms; with ``extending``, to the whole
    words that begin with one of them.
    """
    low, high = settings.prefixes

    def run(batches):
        table, found = folding(), Counter()
        heads = {t[:low].rstrip() for t in wanted} if wanted else None
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = _words(text, table)
                if heads is not None:
                    words = [w for w in words if w[:low] in heads]
                terms = set()
                for w in words:
                    begins = [w[:n] for n in range(low, min(high, len(w) - 1) + 1)]
                    if extending:
                        if any(b in wanted for b in begins):
                            terms.add(w + " ")
                    else:
                        terms.update(begins)
                        terms.add(w + " ")
                found.update(terms & wanted if wanted and not extending else terms)
        terms = list(found)
        for at in range(0, len(terms), 50000):
            part = terms[at : at + 50000]
            yield pa.record_batch([pa.array(part), pa.array([found[k] for k in part])], names=["term", "n"])

    return run


def _counted(rows, settings, *how):
    counts = rows.select("text").mapInArrow(_term_counts(settings, *how), "term string, n long")
    return counts.groupBy("term").agg(F.sum("n").alias("n"))


def _without_copies(chosen):
    """Drop terms that a shorter chosen beginning already stands for."""
    kept = {}
    for term, weight in sorted(chosen.items(), key=lambda x: (len(x[0]), x[0])):
        if not any(kept.get(term[:n], -1) >= weight - 0.5 for n in range(3, len(term))):
            kept[term] = weight
    return kept


def automaton(lexicon):
    made = ahocorasick.Automaton()
    for term, weight in lexicon.weights.items():
        made.add_word(f" {term}", (len(term) + 1, weight))
    if lexicon.weights:
        made.make_automaton()
    return made


def strength(text, table, made):
    """Weight of the longest matches, normalised by length, and their number."""
    folded = fold(text, table)
    best = {}
    for end, (length, weight) in made.iter(folded) if len(made) else ():
        best[end - length] = weight  # ends grow, so the longest match at a start comes last
    hits = [w for w in best.values() if w > 0]
    return sum(hits) / (1 + math.log1p(folded.count(" ") / 200)), len(hits)


def _strengths(lexicon, extra, kinds):
    def run(batches):
        table, made = folding(), automaton(lexicon)
        for batch in batches:
            pairs = [strength(t or "", table, made) for t in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in extra]
            x = np.array([p[0] for p in pairs], float)
            scores = 1 / (1 + np.exp(-(lexicon.slope * x + lexicon.offset)))
            values = {"strength": x, "score": scores, "n_hits": np.array([p[1] for p in pairs], np.int64)}
            yield pa.record_batch([*columns, *(pa.array(values[k]) for k in kinds)], names=[*extra, *kinds])

    return run


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Lexicon:
    """Learn terms, exceptions and the score from a bounded sample of labelled documents."""
    sample = stored(labelled_sample(docs, labels, "toxic", settings.sample).select("text", "label"))
    totals = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return Lexicon()
    toxic, other = sample.where("label = 1"), sample.where("label = 0")
    often = _counted(toxic, settings).where(F.col("n") >= settings.least_documents)
    found = {r.term: r.n for r in often.orderBy(F.desc("n"), "term").limit(settings.candidates).collect()}
    known = {r.term: r.n for r in _counted(other, settings, frozenset(found)).collect()} if found else {}
    odds = {
        t: math.log((n + 0.5) / (totals[1] + 1)) - math.log((known.get(t, 0) + 0.5) / (totals[0] + 1))
        for t, n in found.items()
    }
    clear = sorted((-odds[t] * found[t], t) for t in found if odds[t] >= settings.least_log_odds)[: settings.terms]
    weights = _without_copies({t: odds[t] for _, t in clear})
    begins = frozenset(t for t in weights if not t.endswith(" "))
    if begins:
        # Longer words that begin like a term but occur in harmless documents only.
        longer = _counted(other, settings, begins, True).where(F.col("n") >= settings.least_documents)
        top = longer.orderBy(F.desc("n"), "term").limit(settings.terms).collect()
        weights |= {r.term: 0.0 for r in top if r.term not in found}
    table = folding()
    weights |= {f"{fold(phrase, table).strip()} ": 0.0 for phrase in settings.exceptions}
    lexicon = Lexicon(weights)
    rows = sample.mapInArrow(_strengths(lexicon, ["label"], ["strength"]), "label int, strength double").collect()
    lexicon.slope, lexicon.offset = logistic(
        np.array([r.strength for r in rows]), np.array([r.label for r in rows], float)
    )
    return lexicon


def logistic(x, y, ridge=1e-2, rounds=50):
    """Slope (at least 0) and offset of a ridge logistic regression by Newton steps."""
    design = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
    return max(float(w[0]), 0.0), float(w[1])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, n_hits) for every row."""
    return texts(docs).mapInArrow(
        _strengths(lexicon, ["doc_id"], ["score", "n_hits"]), "doc_id long, score double, n_hits long"
    )


def toxicity(docs: DataFrame, labels: DataFrame, threshold=0.3, settings: Settings = Settings()) -> DataFrame:
    """Every row with doc_id, held_out, score, predicted and n_hits."""
    return score(docs, fit(docs, labels, settings)).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
        "n_hits",
    )
