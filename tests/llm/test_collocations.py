"""Operator 13 against a plain count of every phrase."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from lakelens.llm import collocations as c


def brute(rows, least, longest=4, limit=2000):
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    chosen = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    dropped = set()
    for (lang, p), a in chosen.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 80 * f[lang, p[i : i + k]]:
                    dropped.add((lang, p[i : i + k]))
    by = defaultdict(list)
    for (lang, p), a in chosen.items():
        if (lang, p) not in dropped:
            score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            by[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
            for lang, v in by.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:limit])]


@pytest.mark.parametrize("options", [{}, {"sample": 64, "most_bits": 16}, {"sample": 1, "counted_bytes": 3000}])
def test_collocations_equal_brute_force(spark, sf001, options):
    rows = sf001.collect()
    for least in (3, 12) if options else (3, 30):
        got = [tuple(r) for r in c.collocations(sf001, least=least, **options).collect()]
        assert sorted(got) == sorted(brute(rows, least)) and got


def test_odd_documents(spark, odd, empty):
    more = spark.createDataFrame(
        [(20 + i, "New\tYork, new YORK  new york; one two three four five\x0bNew york one\x85two three four " * 4, None if i % 2 else "und", "s", 1)
         for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").union(more).selectExpr("*", "1 as k", "'x' as phrase", "2 as n", "3 as h")
    for least in (2, 30):
        assert sorted(map(tuple, c.collocations(docs, least=least, counted_bytes=50).collect())) == sorted(brute(docs.collect(), least))
    assert sorted(map(tuple, c.collocations(docs, limit=3).collect())) == sorted(brute(docs.collect(), 30, limit=3))
    assert c.collocations(empty).count() == 0


def test_failures_of_the_border_open_further_passes(spark, monkeypatch):
    """Phrases that the sample holds not at all are found, level after level."""
    docs = spark.createDataFrame([(i, f"alpha beta gamma delta w{i}", "en") for i in range(200)], "doc_id long, text string, lang string")
    hidden = spark.createDataFrame([(i, "w", "en") for i in range(200)], "doc_id long, text string, lang string")
    passes, whole = [], c.counted

    def counted(rows, *a, **k):
        passes.append(k.get("hashes_only", False))
        return whole(hidden.select("lang", "text") if passes[-1] else rows, *a, **k)

    monkeypatch.setattr(c, "counted", counted)
    got = {r.phrase: r.n for r in c.phrase_counts(docs).collect()}
    assert got["alpha beta gamma delta"] == got["beta gamma"] == 200 and passes == [True, False, False]


def test_scores_pass_64_bits(spark, monkeypatch):
    big = 8 * 10**18
    table = spark.createDataFrame([("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7)],
                                  "lang string, k int, phrase string, n long")
    monkeypatch.setattr(c, "phrase_counts", lambda docs, **k: table)
    (r,) = c.collocations(table).collect()
    assert (r.a, r.l, r.r, r.score) == (big - 7, big, big - 1, 2000000 * (big - 7) // (2 * big - 1))


def test_meeting_hashes_are_told_apart():
    import numpy as np

    w = np.array([0, 1, 2, 0, 1, 3, -1, 0, 1])
    place = np.array([0, 1, 3, 4, 7])
    p, n = c.grouped(w, place, np.array([5, 5, 5, 5, 5], np.uint64), 2)
    assert {(w[i], w[i + 1]): m for i, m in zip(p.tolist(), n.tolist())} == {(0, 1): 3, (1, 2): 1, (1, 3): 1}
    assert sorted(c.grouped(w, place, np.array([5, 6, 5, 7, 5], np.uint64), 2)[1].tolist()) == [1, 1, 3]
