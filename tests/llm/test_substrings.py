"""Operator 3 against a brute-force search of every 50-byte string."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from lakelens.llm import suffix_dedup

LAST = 1 << 63


def brute(rows, length=50):
    first = {}
    texts = [(LAST if d is None else d, d, (t or "").encode()) for d, t in rows]
    for order, _, t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if first.get(w, LAST + 1) > order:
                first[w] = order
    out = Counter()
    for order, doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < order:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc, len(t), len(t) - len(kept), spans, kept] += 1
    return out


def edited_family(seed=5):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcd ef") for _ in range(n))
    base, line = text(3000), text(57)
    out = [base, text(49), text(50), "a" * 400, "a" * 700, "ab" * 300, line]
    out += [out[2], "x" + out[2] + "y"]
    for _ in range(25):
        copy = list(base[rng.randrange(500) : rng.randrange(1200, 3000)])
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = rng.choice("XYZé")
        out.append(text(rng.randrange(80)) + "".join(copy) + line + text(rng.randrange(200)) + line * rng.randrange(3))
    out += [text(rng.randrange(60)) + line + text(30) for _ in range(40)]
    rng.shuffle(out)
    return list(enumerate(out))


def test_ranks_name_equal_bytes_equally():
    import numpy as np

    ranks = suffix_dedup.Ranks()
    data = np.frombuffer(b"xxhello worldyyyhello worldzz", np.uint8)
    sums = ranks.read(data)
    a = np.array([2, 16, 3])
    names = ranks.of(sums, a, a + 11)
    assert names[0] == names[1] != names[2]


@pytest.mark.parametrize("segment", [1 << 22, 300])
def test_every_repeated_byte_goes(spark, odd, monkeypatch, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    family = spark.createDataFrame([*edited_family(), (3, "part of a document that has this id " * 4), (None, "a" * 60)], "doc_id long, text string")
    for docs in (family.repartition(4), odd.where("length(text) < 80000 or text is null")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = suffix_dedup.dedup_substrings(docs, bits=18).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(rows)


def test_sample_of_the_documents(spark, sf001, empty):
    rows = [(r.doc_id, r.text) for r in sf001.select("doc_id", "text").collect()]
    got = suffix_dedup.dedup_substrings(sf001, bits=20).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(rows)
    assert suffix_dedup.dedup_substrings(empty, bits=16).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.dedup_substrings(empty, length=20)


def written_rows(monkeypatch, module):
    """Rows of each kind of table that a module writes from now on."""
    made, kept = Counter(), module.kept_table

    def counting(df, name):
        table = kept(df, name)
        made[name] += table.count()
        return table

    monkeypatch.setattr(module, "kept_table", counting)
    return made


@pytest.mark.parametrize("together", [2, 1000])
def test_classes_of_one_name_are_compared_in_place(spark, monkeypatch, together):
    """Windows become rows only for names with more classes than a task compares."""
    made = written_rows(monkeypatch, suffix_dedup)
    rows = edited_family(seed=11)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in suffix_dedup.dedup_substrings(df, bits=16, together=together).collect())
    got = Counter({(*k[:4], bytes(k[4])): n for k, n in got.items()})
    assert got == brute(rows)
    assert made["decided"] > 0
    assert (made["windows"] > 0) == (together == 2)


def test_texts_read_together_are_read_as_each_alone():
    """Runs, chunks and groups of many short texts at once: those of every text, and none across texts."""
    import numpy as np

    ranks, texts = suffix_dedup.Ranks(), [t.encode() for _, t in edited_family(seed=4)] + [b"a" * 50, b"a" * 51, b"ab" * 40]
    texts = [t for t in texts if len(t) >= 50]
    stretches = [(i, 100 + i, 7 * i, t) for i, t in enumerate(texts)]

    def described(s):
        out = list(zip(s.of.tolist(), (s.first + s.shift[s.of]).tolist(), (s.end + s.shift[s.of]).tolist(), s.name.tolist(), strict=True))
        chunks = list(zip(s.chunk_of.tolist(), (s.chunk_first + s.shift[s.chunk_of]).tolist(), (s.chunk_end + s.shift[s.chunk_of]).tolist(), s.chunk_names().tolist(), strict=True))
        groups = [g for pair, a, b, _, of in s.groups(np.arange(len(s.first)))
                  for g in zip(of.tolist(), (a + s.shift[of]).tolist(), (b + s.shift[of]).tolist(), pair.tolist(), strict=True)]
        return [[(s.ids[i], s.keys[i], *rest) for i, *rest in rows] for rows in (out, chunks, groups)]

    together = described(suffix_dedup.Segments(stretches, ranks, 50, 16))
    alone = [described(suffix_dedup.Segments([x], ranks, 50, 16)) for x in stretches]
    for n, rows in enumerate(together):
        assert sorted(rows) == sorted(r for one in alone for r in one[n])
    runs = Counter()
    for i, _, a, b, _ in together[0]:
        runs[i] += b - a
    assert runs == Counter({i: len(t) - 49 for i, t in enumerate(texts)})


def test_last_round_gets_no_more_rows_when_names_are_many(spark, monkeypatch):
    """Filters grow with the names that they hold: texts of one document don't pass by chance."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    common = [text(8000) for _ in range(30)]
    changed = lambda t: "".join(t[at : at + 100] + rng.choice("XYZ") for at in range(0, len(t), 100))
    rows = [(i, text(8000) + changed(common[i % 30])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sent = []
    for bits in (16, 24):
        with monkeypatch.context() as patch:
            made = written_rows(patch, suffix_dedup)
            got = suffix_dedup.dedup_substrings(df, bits=bits).collect()
            sent.append(made["round-3"])
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(rows)
    assert 0 < sent[0] < 1.1 * sent[1]


def test_filters_hold_all_their_names(spark):
    """Names of a filter are found in it; of others few, however many it holds."""
    import numpy as np

    rng = np.random.default_rng(1)
    names, others = (rng.integers(0, 1 << 63, 40_000, np.uint64) * np.uint64(2) for _ in range(2))
    blobs = [(suffix_dedup.NAMES, int(b), int(n), low.astype(np.uint32).tobytes()) for b in np.unique(names >> np.uint64(52))
             for low in [(suffix_dedup.name_keys(names[names >> np.uint64(52) == b]) & suffix_dedup.LOW)] for n in [len(low)]]
    table = spark.createDataFrame(blobs, "kind int, bucket int, n long, blob binary")
    made = suffix_dedup.filter_of(table, suffix_dedup.NAMES, 18)
    assert suffix_dedup.in_filter(made, suffix_dedup.name_keys(names)).all()
    assert suffix_dedup.in_filter(made, suffix_dedup.name_keys(others)).mean() < 0.05
    empty = suffix_dedup.filter_of(table, suffix_dedup.CHUNKS, 15)
    assert not suffix_dedup.in_filter(empty, suffix_dedup.name_keys(others)).any()


def test_names_are_sent_once_or_twice_and_chunks_with_their_first_document():
    import numpy as np
    import pyarrow as pa

    big = np.uint64(0xFFF0000000000000)
    names = [np.array([5, big, 5, 5, big + np.uint64(1 << 20)], np.uint64), np.array([7, big], np.uint64)]
    assert sorted(suffix_dedup.once_a_text(np.array([9, 9, 4, 9], np.uint64), np.array([0, 0, 0, 1])).tolist()) == [4, 9, 9]
    chunks = [(np.array([big, 3, big], np.uint64), np.array([8, -2, 6]))]
    rows = [r for part in [*suffix_dedup.sent(names, chunks), *suffix_dedup.sent([], [(np.array([3], np.uint64), np.array([-5]))])] for r in part.to_pylist()]
    assert [(r["kind"], r["bucket"], len(r["blob"])) for r in rows] == [(0, 0, 12), (0, 4095, 12), (1, 0, 16), (1, 4095, 16), (1, 0, 16)]
    rows.sort(key=lambda r: (r["kind"], r["bucket"]))
    [out] = suffix_dedup.bucket_survivors([pa.RecordBatch.from_pylist(rows)])
    low = {(r["kind"], r["bucket"]): np.frombuffer(r["blob"], np.uint32).tolist() for r in out.to_pylist()}
    owner = lambda name, doc: int(suffix_dedup.owner_keys(np.array([name], np.uint64), np.array([doc]))[0]) & 0xFFFFFFFF
    assert low == {(0, 0): [0], (0, 4095): [0], (1, 0): [owner(3, -5)], (1, 4095): [owner(big, 6)]}
    assert list(suffix_dedup.bucket_survivors([])) == []


def test_shuffle_files_go_with_the_queries_that_made_them(spark, monkeypatch):
    import time

    def shuffles():
        blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
        return {name for name in (blocks.apply(i).name() for i in range(blocks.size())) if name.startswith("shuffle_")}

    monkeypatch.setattr(suffix_dedup, "discard", lambda *tables: None)
    before = shuffles()
    df = spark.createDataFrame(edited_family(seed=2), "doc_id long, text string")
    suffix_dedup.dedup_substrings(df, bits=16)
    for _ in range(40):
        if not shuffles() - before:
            break
        time.sleep(0.25)
    assert not shuffles() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
