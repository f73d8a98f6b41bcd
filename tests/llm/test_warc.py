"""Operator 11: archives against brute force and an independent reader."""

from __future__ import annotations

import base64
import glob
import hashlib
from collections import Counter, defaultdict

import pytest
import zstandard

from lakelens.llm import warc
from lakelens.session import scratch_dir

ROWS = [
    (1, "http://a.example/1", "<p>same</p>"), (2, "http://a.example/2 x\r\ny", "<p>same</p>"), (2, "http://a.example/2", "<p>same</p>"),
    (2, "http://a.example/2", "<p>same</p>"), (None, None, "<p>same</p>"), (None, "u", "only null id"), (3, "", None), (4, "é", ""),
    (5, "http://l", "long 中 " * 60000), (6, "http://l", "long 中 " * 60000), (7, "http://c", "a\r\n\r\nb\r\n\r\nWARC/1.1\r\n"),
]


@pytest.fixture(scope="module")
def pages(spark):
    many = [(100 + i, f"http://h/{i}", f"<html><title>page {i % 150}</title><body>{'common words ' * 9}{i % 150}</body></html>") for i in range(400)]
    return spark.createDataFrame([r + (9, "x", 1) for r in ROWS + many], "page_id long, url string, html string, row long, sha string, salt int")


def expected(rows, least=0):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.html or "").encode()].append(-1 if r.page_id is None else r.page_id)
    out = Counter()
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids = sorted(ids)
        for i, page in enumerate(ids):
            first = i == len(ids) - 1 or len(payload) < least
            out[None if page < 0 else page, len(payload), digest, "response" if first else "revisit",
                None if first or ids[-1] < 0 else ids[-1]] += 1
    return out


def test_archived_equals_brute_force(spark, pages):
    assert Counter(map(tuple, warc.archived(pages).collect())) == expected(pages.collect())
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert Counter(map(tuple, warc.archived(given).collect())) == expected(given.collect())


def test_short_payloads_are_all_responses(spark, pages):
    path = scratch_dir(spark, "warc")
    warc.write_archives(pages, path, min_bytes=20)
    got = warc.read_archives(spark, path)
    assert Counter((r.record_type, r.payload_bytes < 20) for r in got.collect()) == Counter(
        k for (_, n, _, kind, _), c in expected(pages.collect(), 20).items() for k in [(kind, n < 20)] * c)


def test_archives_follow_the_format(spark, pages):
    """A plain reader of the compression format finds the dictionary first, then whole records."""
    path = scratch_dir(spark, "warc")
    warc.write_archives(pages.repartition(3), path, archive_bytes=1 << 20)
    texts, with_words = Counter(), 0
    for name in glob.glob(f"{path.removeprefix('file:')}/part-*"):
        data, words = open(name, "rb").read(), None
        if data[:4] == warc.DICTIONARY_MAGIC:
            with_words += 1
            size = int.from_bytes(data[4:8], "little")
            words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
            assert words.dict_id()
        whole = zstandard.ZstdDecompressor(dict_data=words).stream_reader(data, read_across_frames=True).read()
        while whole:
            head, _, rest = whole.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            block, whole = rest[:n], rest[n:].removeprefix(b"\r\n\r\n")
            if fields["WARC-Type"] == "response":
                texts[block.partition(b"\r\n\r\n")[2]] += 1
            else:
                assert "WARC-Refers-To" in fields
    assert texts == Counter({(r.html or "").encode() for r in pages.collect()}) and with_words
    # each record can be read by its offset and length alone
    for r in warc.read_archives(spark, path).limit(5).collect():
        data = open(r.archive.removeprefix("file:"), "rb").read()
        found = [x for x in warc.records_in(data) if x[0] == r.offset]
        assert len(found) == 1 and found[0][1] == r.length


def test_empty_table_and_damage(spark, pages):
    assert warc.archived(pages.where("false")).count() == 0
    good = warc.record("1", 1, "u", b"payload", None, None, "2000-01-01T00:00:00Z")
    assert warc.facts(good)[4] == 7
    with pytest.raises(ValueError):
        warc.facts(good.replace(b"payload", b"paiload"))
    frames = b"".join(warc.frames_of(iter([good] * 3), level=3, dictionary_bytes=1024, sample_bytes=1 << 20))
    assert len(list(warc.records_in(frames))) == 3
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.records_in(frames[:-5]))
