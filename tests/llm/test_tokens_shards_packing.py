"""Operators 1, 2, 6 and 10 against the tokenizer library and brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakelens.llm import digest_index, packing, sharding, token_counts
from lakelens.llm.queries import tokenizer_path
from lakelens.session import scratch_dir


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_token_counts_equal_the_library(spark, odd, sf001, library, chunk):
    for docs in (odd, sf001) if chunk > 7 else (odd.where("length(text) < 100 or text is null"),):
        got = Counter(tuple(r) for r in token_counts.token_counts(docs, tokenizer_path(), chunk_bytes=chunk).collect())
        assert got == Counter((r.doc_id, len((r.text or "").encode()), len(ids_of(library, r.text))) for r in docs.collect())


def test_transducer_on_hard_words(library):
    transducer = token_counts.TokenTransducer(tokenizer_path())
    words = ["'s", "''s", "'rest", "l'lle", "'ll'd", "x'", "''", "'r", "</w>", "a</w>b", "<|endoftext|>a", "A" * 500,
             "İ", "ﬁ²Ⅷ", "á̧", "!!!" * 99, "9'9", " ", "a​b"]
    assert [transducer.count(w.encode()) for w in words] == [len(ids_of(library, w)) for w in words]


def test_state_maps_compose_in_any_grouping():
    transducer = token_counts.TokenTransducer(tokenizer_path())
    text = b"one two  three'll four\n" * 3 + b"unbroken" * 9
    whole = sum(map(transducer.count, text.split()))

    def joined(a, b):
        if a[2] is None:
            return (a[0] + b[0], a[1] + b[1], b[2])
        if b[2] is None:
            return (a[0], a[1], a[2] + b[0])
        return (a[0], a[1] + transducer.count(a[2] + b[0]) + b[1], b[2])

    maps = [transducer.state_map(text[i : i + 5]) for i in range(0, len(text), 5)]
    while len(maps) > 1:
        maps = [joined(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    head, n, tail = maps[0]
    assert transducer.count(head) + n + transducer.count(tail) == whole


def test_shards_hold_the_mixture_and_equal_counts(spark, odd, sf001, empty):
    for docs in (odd, sf001):
        rows = sharding.interleave(docs, 4, slots=16).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
            (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        assert sorted(by) == [0, 1, 2, 3] and max(map(len, by.values())) - min(map(len, by.values())) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        share = Counter((r.source, r.shard) for r in rows)
        for source, n in Counter(r.source for r in rows).items():
            assert all(abs(share[source, s] - n / 4) <= 2.5 for s in range(4))
    assert sharding.interleave(empty).count() == 0
    again = sharding.sharded(sf001.repartition(5)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, sharding.sharded(sf001).collect()), key=str)


def lowered(text):
    return (text or "").encode().lower()


def test_digest_index_keeps_the_largest_id_and_remembers(spark, odd, empty):
    docs = odd.collect()
    groups = defaultdict(list)
    for r in docs:
        groups[lowered(r.text)].append(r.doc_id)
    top = {k: max((d for d in v if d is not None), default=None) for k, v in groups.items()}
    index = digest_index.DigestIndex(spark, scratch_dir(spark, "index"), buckets=4)
    got = index.add(odd, batch="one").collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.seen) for r in got) == Counter(
        (r.doc_id, top[lowered(r.text)], len(groups[lowered(r.text)]), hashlib.sha256(lowered(r.text)).hexdigest(), False) for r in docs)
    kept = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in kept}) == len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert index.rows().count() == len(groups)
    # the index outlives its opener; a second batch adds only what is new
    again = digest_index.DigestIndex(spark, index.path, buckets=4)
    more = odd.selectExpr("doc_id + 100 as doc_id", "text").union(spark.createDataFrame([(500, "NEW"), (501, "new")], "doc_id long, text string"))
    second = again.add(more, batch="two").collect()
    assert [(r.doc_id, r.keep_id) for r in second if r.kept] == [(501, 501)]
    assert all(r.keep_id == top[lowered(None)] for r in second if r.seen and r.text_sha256 == hashlib.sha256(b"").hexdigest())
    assert again.rows().count() == len(groups) + 1
    assert again.add(empty).count() == 0 and again.rows().count() == len(groups) + 1


def test_packing_is_whole_dense_and_exact(spark, odd, sf001, empty, library):
    for docs in (odd, sf001):
        pieces = packing.pack(docs, tokenizer_path()).collect()
        texts = Counter((r.doc_id, tuple(ids_of(library, r.text) + [1])) for r in docs.collect())
        by = defaultdict(list)
        for p in pieces:
            by[p.doc_id, p.doc_tokens].append(p)
        whole = Counter()
        for (doc, n), group in by.items():
            copies = sum(c for (d, ids), c in texts.items() if (d, len(ids)) == (doc, n))
            at = defaultdict(list)
            for p in group:
                at[p.start].append(p)
            assert sum(p.length for p in group) == n * copies
            if copies == 1:
                joined = b"".join(bytes(at[s][0].ids) for s in sorted(at))
                whole[doc, tuple(np.frombuffer(joined, "<u4").tolist())] += 1
        assert all(texts[k] for k in whole)
        rows, padding = defaultdict(list), 0
        for p in pieces:
            rows[p.sequence_id].append((p.offset, p.length))
        for found in rows.values():
            end = 0
            for offset, length in sorted(found):
                assert offset == end and length > 0
                end += length
            assert end <= 2048
            padding += 0 if end & (end - 1) == 0 else 2048 - end
        assert padding <= 0.02 * sum(p.length for p in pieces) + 2048 * docs.rdd.getNumPartitions()
        digest = packing.packed_digest(packing.pack(docs, tokenizer_path())).collect()
        assert Counter((r.doc_id, r.start, r.ids_crc32) for r in digest) == Counter((p.doc_id, p.start, zlib.crc32(p.ids)) for p in pieces)
    assert packing.pack(empty, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, tokenizer_path(), capacity=1000)
