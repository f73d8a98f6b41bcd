"""Substring deduplication by sliding sentence spans (operator 7).

A text is cut into sentences: behind a sentence sign of any script or a line break,
and before a capitalised word, so that a passage pasted into the middle of a sentence
begins one of its own.  A character of a script without spaces is a
word.  From every sentence a span runs over several consecutive
sentences: at least ``LEAST_SENTENCES`` and at least ``LEAST_WORDS`` words.  Spans
are joined over all documents by hash; a span stays where it occurs first
(smallest document id, then place) and the sentences that any other occurrence
covers are removed.  Spans compare words with A-Z lower-cased; the amount of
white space between words doesn't count.

A long passage need not hold whole sentences: one of 60 words, or parts of two.  With a
``reach`` (the registered query's is ``REACH``) there are also spans of exactly ``RUN``
words that begin at the word with the smallest hash of ``reach`` words.  That depends on
no other words, so a passage of reach + RUN - 1 words that is repeated word by word holds one in
all its places, wherever its sentences begin and end, and less than ``reach`` words at each
of its ends can stay.  Shorter stretches in the middle of a sentence are left alone.

The first pass finds the repeated spans (counted by hash, combined before the
shuffle); the second sends only places whose hash hits a bitmap of those, and the
join decides exactly.  A span that a third of all documents share is one row a
document in a join that Spark can split.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.words import PrefixHashes, WordTable, hash_bitmap, in_bitmap, kept_table, remembered

LEAST_SENTENCES, LEAST_WORDS = 2, 12
BITS = 26
LAST_ID = (1 << 63) - 1

#: Their sum less one is 51: every repeated passage of over 50 words holds a whole run.
REACH, RUN = 16, 36

WORD = re.compile(r"\s*\S+\s*|\s+")
#: Thai, Lao, Burmese, Khmer, kana, Han and full-width characters.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
HAS_UNSPACED = re.compile(f"[{UNSPACED}]")
WORD_OR_SIGN = re.compile(rf"\s*(?:[{UNSPACED}]|[^\s{UNSPACED}]+)\s*|\s+")
SIGNS = frozenset(".!?。！？．｡।॥؟۔։።፧፨៕")


def words_of(text: str) -> list[str]:
    """The words with their white space; together they are the text."""
    return (WORD if text.isascii() or not HAS_UNSPACED.search(text) else WORD_OR_SIGN).findall(text)


def described(raw: str) -> tuple[int, bool, bool]:
    """Of a word with its white space: hash, begins a sentence, ends one."""
    import xxhash

    word = raw.strip()
    ends = not word or word.rstrip("\"')]»”’")[-1:] in SIGNS or "\n" in raw
    return xxhash.xxh3_64_intdigest(word.encode().lower()), word[:1].isupper(), ends


def word_table() -> WordTable:
    return WordTable(described, (np.uint64, bool, bool))


def sentence_spans(texts: list[str], memo: WordTable, prefix: PrefixHashes, sentences: int, words: int, reach: int = 0, run: int = RUN):
    """For each span: text number, first word, word behind the last, hash."""
    split = [words_of(t) for t in texts]
    flat = list(chain.from_iterable(split))
    size = np.array([len(ws) for ws in split], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    if not flat:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64)
    at = memo.numbers(flat)
    hashes, begins, ends = (column[at] for column in memo.columns)
    begins[1:] |= ends[:-1]
    begins[first[:-1][size > 0]] = True

    edges = np.append(np.flatnonzero(begins), len(flat))  # first words of sentences
    a = edges[:-1]
    of = np.searchsorted(first, a, side="right") - 1
    to = np.maximum(np.arange(len(a)) + sentences, np.searchsorted(edges, a + words))
    ok = to < len(edges)
    ok[ok] = edges[to[ok]] <= first[of[ok] + 1]
    a, b, of = a[ok], edges[to[ok]], of[ok]
    if reach and len(flat) >= run:
        known = np.zeros(len(flat), np.int64)
        known[a] = b
        more = least_places(hashes, first, reach)
        its = np.searchsorted(first, more, side="right") - 1
        new = (more + run <= first[its + 1]) & (known[more] != more + run)
        a, b, of = (np.concatenate([x, y[new]]) for x, y in ((a, more), (b, more + run), (of, its)))
    return of, a - first[of], b - first[of], prefix.spans(hashes, a, b)


def least_places(hashes: np.ndarray, first: np.ndarray, reach: int) -> np.ndarray:
    """Places with the smallest hash (its upper half) of ``reach`` words in a row, the first of equal ones, within a text."""
    n = len(hashes) - reach + 1
    if n <= 0:
        return np.empty(0, np.int64)
    place = np.uint64(0xFFFFFFFF)
    least, width = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64), 1
    while width < reach:  # the least of width words from each place, then of more
        step = min(width, reach - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    within = np.ones(n, bool)
    for end in first[1:-1].tolist():
        within[max(0, end - reach + 1) : end] = False
    chosen = np.zeros(len(hashes), bool)
    chosen[(least[within] & place).astype(np.int64)] = True
    return np.flatnonzero(chosen)


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (a hash that, with the id, tells rows of different texts apart) and t."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"),
                       F.col(id_col).isNull().alias("no_id"), F.xxhash64(id_col, text).alias("key"), text.alias("t"))


def span_rows(keyed: DataFrame, sentences: int, words: int, bitmap=None, bits: int = BITS, reach: int = 0,
              run: int = RUN) -> DataFrame:
    """Spans as rows: id, key, h, a, b and again (not the hash's first place in its text).
    Without a bitmap only id, h and again, once for each hash of a batch and id."""
    import pyarrow as pa

    def rows(batches):
        memo, prefix = remembered("sentence words", word_table), PrefixHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                of, a, b, h = sentence_spans(part.column("t").to_pylist(), memo, prefix, sentences, words, reach, run)
                order = np.lexsort((a, h, of))
                of, a, b, h = of[order], a[order], b[order], h[order]
                again = np.zeros(len(h), bool)
                again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
                if bitmap is not None:
                    hit = in_bitmap(bitmap.value, h, bits)
                    of, a, b, h, again = of[hit], a[hit], b[hit], h[hit], again[hit]
                which = pa.array(of)
                columns = [part.column("id").take(which), pa.array(h.view(np.int64)), pa.array(again)]
                names = ["id", "h", "again"]
                if bitmap is not None:
                    columns += [part.column("key").take(which), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
                    names += ["key", "a", "b"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", key long, a long, b long" if bitmap is not None else ""
    return keyed.select("id", "key", "t").mapInArrow(rows, f"id long, h long, again boolean{more}")


def dedup_sentences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    sentences: int = LEAST_SENTENCES, words: int = LEAST_WORDS, bits: int = BITS, reach: int = 0,
                    run: int = RUN) -> DataFrame:
    """doc_id, n_bytes, n_removed (bytes), n_spans (runs of removed words) and kept_text
    of every row of ``docs``.

    Null and empty texts have nothing to remove, nor have texts too short for a
    span.  Rows that share an id are parts of one document: a span in two of them
    stays in both.  A null id comes after all others.  Repeated rows are rows of
    their own with the same result.  Other columns are not read; an empty table
    gives no rows.  Whole texts are read however long.  Without a ``reach`` only whole
    sentences are removed.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    keyed = keyed_texts(docs, id_col, text_col)
    counted = span_rows(keyed, sentences, words, reach=reach, run=run).groupBy("h").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.max("again").alias("twice"))
    repeated = kept_table(counted.where((F.col("first") < F.col("last")) | F.col("twice")).select("h", "first"), "spans")
    bitmap = spark.sparkContext.broadcast(hash_bitmap(repeated, "h", bits))
    places = span_rows(keyed, sentences, words, bitmap, bits, reach, run).join(repeated, "h")
    covered = (places.where((F.col("id") > F.col("first")) | F.col("again")).groupBy("id", "key")
               .agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    joined = keyed.join(covered, ["id", "key"], "left").select("id", "no_id", "t", "spans.a", "spans.b")

    def cut(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text"]
        for batch in batches:
            ids = [None if no else i for i, no in zip(batch.column("id").to_pylist(), batch.column("no_id").to_pylist(), strict=True)]
            out = []
            for doc, text, a, b in zip(ids, *(batch.column(c).to_pylist() for c in "tab"), strict=True):
                size = len(text.encode())
                if not a:
                    out.append((doc, size, 0, 0, text))
                    continue
                pieces = words_of(text)
                steps = np.zeros(len(pieces) + 1, np.int64)
                np.add.at(steps, a, 1)
                np.add.at(steps, b, -1)
                gone = np.cumsum(steps[:-1]) > 0
                kept = "".join(p for p, g in zip(pieces, gone.tolist(), strict=True) if not g)
                out.append((doc, size, size - len(kept.encode()), int(gone[0]) + int(np.sum(gone[1:] & ~gone[:-1])), kept))
            kinds = [pa.int64()] * 4 + [pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text string")


def spans_digest(docs: DataFrame) -> DataFrame:
    """The result for every document with the SHA-256 of the kept text in its place."""
    return dedup_sentences(docs, reach=REACH).withColumn("kept_sha256", F.sha2(F.encode("kept_text", "UTF-8"), 256)).drop("kept_text")
