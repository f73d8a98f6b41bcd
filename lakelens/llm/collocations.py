"""Phrase collocations mined by Toivonen's method (operator 13).

1. A sample of the documents proposes phrases: those that occur often enough there,
   with a lowered threshold.
2. A pass over all documents counts, exactly, every phrase whose proper parts were all
   proposed: the proposed phrases and their negative border.
3. A phrase of the border that turns out frequent is a failure: longer phrases around it
   were not counted.  It is added to the proposals and another pass counts what that
   opens, until a pass brings nothing new.  Such a pass takes phrases that no pass has
   counted as open too, so one of them closes the search; the next would only confirm it.

The result doesn't depend on the sample; a bad one costs a pass.  What is proposed goes
to the tasks as a bitmap of phrase hashes of bounded size.  Chance hits in it let more
phrases be counted and can't change a count: whether a phrase is counted depends on the
phrase alone, and counts are kept by its words.

A task numbers its words, counts stretches of numbers with numpy (grouped by hash, word by
word compared) and ships a row for each distinct phrase, which Spark adds up.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakelens.llm.words import discard, hash_bitmap, in_bitmap, kept_table, mixed

#: One document in so many is in the sample.
SAMPLE = 8

#: Size of the bitmap of proposed phrases: at most 2^27 bits (16 MB), 16 a phrase below that.
MOST_BITS = 27

#: Bytes of text that a task counts together; a long text is read in slices of as much (up to the end of a piece).
COUNTED = 8 << 20

SIGNS = b".,;:!?\x0a\x0b\x0c\x0d"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + SIGNS, b"abcdefghijklmnopqrstuvwxyz " + b"\xff" * len(SIGNS))
BOUNDARY = b"\xff"  # never part of UTF-8


def slices(text: bytes, size: int):
    """The folded text, a long one in parts that end at the end of a piece."""
    text, at = text.translate(FOLD), 0
    while len(text) - at > size:
        end = text.find(BOUNDARY, at + size)
        if end < 0:
            break
        yield text[at : end + 1]
        at = end + 1
    yield text[at:] if at else text


def numbered(parts: list[bytes]):
    """Words of folded texts as numbers (-1: a boundary), and the distinct words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    blob = BOUNDARY.join(parts).replace(BOUNDARY, b" \xff ")
    words = pc.split_pattern(pa.array([blob], pa.large_binary()), pattern=b" ").flatten().dictionary_encode()
    numbers, known = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
    place = {w: i for i, w in enumerate(known) if w in (b"", BOUNDARY)}
    if b"" in place:
        numbers = numbers[numbers != place[b""]]
    if BOUNDARY in place:
        numbers[numbers == place[BOUNDARY]] = -1
    return numbers, known


def joined(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of all its words but the last, and of the last."""
    return mixed(h * np.uint64(0x9E3779B97F4A7C15) + word)


def grouped(w: np.ndarray, place: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """One place and the count of each distinct stretch of ``k`` numbers at ``place``, by hash; if
    hashes of different stretches meet, by their words."""
    order = np.argsort(h)
    p = place[order]
    new = np.ones(len(p), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    for j in range(k):
        if not ((w[p[1:] + j] == w[p[:-1] + j]) | new[1:]).all():
            p = place[np.lexsort([w[place + i] for i in range(k)])]
            new[1:] = np.any([w[p[1:] + i] != w[p[:-1] + i] for i in range(k)], axis=0)
            break
    start = np.flatnonzero(new)
    return p[start], np.diff(start, append=len(p))


def phrase_levels(w: np.ndarray, hashes: np.ndarray, longest: int, bits: int, before, now):
    """k, places and hashes of the phrases to count, level by level.

    ``w`` holds word numbers (-1: a boundary), ``now`` the bitmap of proposals (None:
    all), ``before`` the one of the pass before (None: there was none).  What that pass
    counted is left out, and what it didn't count is open."""
    ok = w >= 0
    word = np.where(ok, hashes[w], 0).astype(np.uint64)
    h, counted = word, ok if before is not None else np.zeros(len(w), bool)
    for k in range(1, longest + 1):
        if k > 1:
            place = np.flatnonzero(ok)
            opens, opened = np.ones(len(place), bool), counted[place]
            if now is not None:
                opens = in_bitmap(now, h[place], bits) | (~opened if before is not None else False)
            if before is not None:
                opened = opened & in_bitmap(before, h[place], bits)
            for flags, found in ((ok, opens), (counted, opened)):
                flags[:] = False
                flags[place] = found
            ok, counted = ok[:-1] & ok[1:], counted[:-1] & counted[1:]
            if not ok.any():
                return
            h = joined(h[:-1], word[k - 1 :])
        else:
            counted = counted.copy()
        place = np.flatnonzero(ok & ~counted)
        yield k, place, h[place]


def counted(docs: DataFrame, longest: int, bits: int, before, now, *, hashes_only: bool = False, counted_bytes: int = COUNTED) -> DataFrame:
    """Rows (h, n) or (phrase, n) of the phrases to count, several a phrase.  A phrase carries its
    language after a tab, which no word holds; the first pass adds an empty
    phrase with the words of each language."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((before, now))  # at most 2^MOST_BITS / 8 bytes each

    def rows_of(lang: str, parts: list[bytes]):
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        before, now = shared.value
        w, known = numbered(parts)
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in known), np.uint64, len(known))
        if not hashes_only:
            tail = pa.scalar("\t" + lang, pa.string())
            texts = pa.array([b"" if x == BOUNDARY else x for x in known], pa.binary()).cast(pa.string())
            if before is None:
                yield pa.record_batch([pa.array(["\t" + lang]), pa.array([int((w >= 0).sum())])], ["phrase", "n"])
        for k, place, h in phrase_levels(w, hashes, longest, bits, before, now):
            if hashes_only:
                h, counts = np.unique(h, return_counts=True)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(counts)], ["h", "n"])
                continue
            place, counts = grouped(w, place, h, k)
            for i in range(0, len(place), 1 << 17):
                some = place[i : i + (1 << 17)]
                each = [texts.take(pa.array(w[some + j])) for j in range(k)]
                phrase = pc.binary_join_element_wise(*each, " ") if k > 1 else each[0]
                phrase = pc.binary_join_element_wise(phrase, tail, "")
                yield pa.record_batch([phrase, pa.array(counts[i : i + (1 << 17)])], ["phrase", "n"])

    def count(batches):
        held, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_buffer()
                for part in slices(raw.to_pybytes() if raw is not None else b"", counted_bytes):
                    held.setdefault(lang.as_py(), []).append(part)
                    size += len(part) + 1
                    if size >= counted_bytes:
                        for key in list(held):
                            yield from rows_of(key, held.pop(key))
                        size = 0
        for key in list(held):
            yield from rows_of(key, held.pop(key))

    return docs.mapInArrow(count, "h long, n long" if hashes_only else "phrase string, n long")


def with_hashes(phrases: DataFrame) -> DataFrame:
    """The column h of (lang, phrase) rows: the hash that ``counted`` knows a phrase by."""
    def hashed(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            out = np.zeros(b.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                seed = xxhash.xxh3_64_intdigest(lang.encode())
                h = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed) for x in phrase.split(" ")], np.uint64)
                one = h[:1]
                for j in range(1, len(h)):
                    one = joined(one, h[j : j + 1])
                out[i] = one[0]
            yield pa.record_batch([pa.array(out.view(np.int64))], ["h"])

    return phrases.select("lang", "phrase").mapInArrow(hashed, "h long")


def phrase_counts(docs: DataFrame, *, least: int = 30, longest: int = 4, sample: int = SAMPLE, most_bits: int = MOST_BITS,
                  id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", counted_bytes: int = COUNTED) -> DataFrame:
    """lang, k, phrase and n (occurrences, exact) of every phrase of 1 to ``longest`` words with at
    least ``least``, and a row with k = 0 for the words of each language.  Tables in the shared folder."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit("toivonen")), F.lit(sample)) == 0)
    lowered = max(2, least * 6 // (10 * sample)) if sample > 1 else least
    proposals = kept_table(
        counted(chosen.select("lang", "text"), longest - 1, 0, None, None, hashes_only=True, counted_bytes=counted_bytes)
        .groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= lowered).select("h"), "phrase-proposals")
    bits = min(most_bits, max(16, (16 * proposals.count()).bit_length()))
    before, now, tables = None, hash_bitmap(proposals, "h", bits), []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # a task has added up its own rows: they are dealt out as they are
        table = kept_table(
            counted(rows.select("lang", "text"), longest, bits, before, now, counted_bytes=counted_bytes)
            .repartition(parts, "phrase").groupBy("phrase").agg(F.sum("n").alias("n"))
            .where((F.col("n") >= least) | F.col("phrase").startswith("\t"))
            .select(F.expr("substring(phrase, instr(phrase, '\t') + 1)").alias("lang"), F.substring_index("phrase", "\t", 1).alias("phrase"), "n")
            .select("lang", F.expr("IF(phrase = '', 0, size(split(phrase, ' ')))").alias("k"), "phrase", "n"), "phrase-counts")
        tables.append(table)
        grown = now | hash_bitmap(with_hashes(table.where((F.col("k") > 0) & (F.col("k") < longest))), "h", bits)
        if before is not None or (grown == now).all():  # no phrase of the border failed, or all that they opened is counted
            break
        before, now = now, grown
    discard(proposals)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t.where("k > 0"))
    return out


def top_of(rows: DataFrame, order: list, limit: int, lots: int) -> DataFrame:
    """The first ``limit`` rows of each language: chosen in lots, then in fewer lots, then together,
    so that no task sorts a whole language."""
    few = math.isqrt(lots - 1) + 1
    rows = rows.withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(lots)))
    for keys in (["lang", "lot"], ["lang", (F.col("lot") % few).alias("few")], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= limit)
    return rows.drop("lot")


def collocations(docs: DataFrame, *, least: int = 30, longest: int = 4, limit: int = 2000, scale: int = 2_000_000, cover: int = 80,
                 **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first ``limit`` phrases of each language.

    A phrase of 2 to ``longest`` words with a >= ``least`` occurrences is cut where the score
    floor(``scale`` * a / (l + r)) is lowest (ties: the first such cut); l and r are the
    occurrences of its two parts, n all words of the language.  Phrases that lie inside a longer one
    with at least ``cover`` percent of their occurrences are dropped.  Ranks go by score, then a (both
    falling), then the phrase's bytes, so there are no ties.

    A null text is empty, a null language ``und``; empty texts have no words; repeated
    rows count as often as they occur, under whatever id.  Long texts are read in slices that end
    at the end of a piece.  An empty table gives no rows; columns not named are not read.
    """
    spark = docs.sparkSession
    counts = phrase_counts(docs, least=least, longest=longest, **options)
    phrases = counts.where("k > 0").select("lang", "k", "phrase", "n")
    candidates = phrases.where("k > 1")

    # each candidate asks for its parts' counts; parts that many ask for are answered apart
    cut = candidates.select("lang", "k", "phrase", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    asked = cut.select("lang", "phrase", "cut", F.posexplode(F.expr(
        "array(substring_index(phrase, ' ', cut), substring_index(phrase, ' ', cut - k))")).alias("side", "part"))
    total = cut.count() * 2
    popular = asked.groupBy("lang", "part").agg(F.count("*").alias("m")).where(F.col("m") > max(1000, total // 1000))
    shown = phrases.select("lang", F.col("phrase").alias("part"), "n")
    popular = F.broadcast(popular.join(shown, ["lang", "part"]).select("lang", "part", F.col("n").alias("at_once")))  # at most 1000 rows
    asked = asked.join(popular, ["lang", "part"], "left")
    answers = (asked.where("at_once is not null").withColumnRenamed("at_once", "n")
               .unionByName(asked.where("at_once is null").drop("at_once").join(shown.hint("merge"), ["lang", "part"])))
    answers = answers.select("lang", "phrase", (2 * F.col("cut") + F.col("side")).alias("what"), "n")

    # and tells the phrases inside it how often it occurs
    words = F.split("phrase", " ")
    inside = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    longer = candidates.where("k > 2").withColumn("words", words).select(
        "lang", F.explode(inside).alias("phrase"), F.lit(0).alias("what"), "n")
    own = candidates.select("lang", "phrase", F.lit(1).alias("what"), "n")

    told = lambda what: F.max(F.when(F.col("what") == what, F.col("n")))
    facts = answers.unionByName(longer).unionByName(own).groupBy("lang", "phrase").agg(
        told(0).alias("longer"), told(1).alias("a"),
        *(told(2 * c + s).alias(f"{'lr'[s]}{c}") for c in range(1, longest) for s in (0, 1)))
    big = lambda c: f"CAST({c} AS DECIMAL(20,0))"
    cuts = ", ".join(f"IF(l{c} IS NULL, NULL, struct({big(scale)} * {big('a')} div ({big(f'l{c}')} + {big(f'r{c}')}) AS score, {c} AS c, l{c} AS l, r{c} AS r))"
                     for c in range(1, longest))
    scored = (facts.where(F.expr(f"longer IS NULL OR {big(100)} * {big('longer')} < {big(cover)} * {big('a')}"))
              .select("lang", "phrase", "a", F.expr(f"array_min(array({cuts}))").alias("best"))
              .select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    top = top_of(scored, order, limit, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sizes = counts.where("k = 0").select("lang", "n")
    return top.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
