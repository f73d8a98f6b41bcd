"""Benchmark decontamination by template canonicalisation (operator 4).

Words become templates: numbers, names and units turn into typed placeholders,
all others into their lower-cased letters.  Windows of ``WINDOW`` template words
are hash-joined with the benchmark's windows, so a question asked again with
other numbers or names still matches.  Placeholders alone prove little, so the
slots are checked: within an occurrence of the item, each value of the item
must stand for one value of the document and the other way round.  Occurrences are
told apart by where they align (place in the document less place in the item): all
hits of one alignment, those of alignments in a band (words put in or left out), and
all hits of the pair.  One that holds enough windows and agrees makes the pair.

Items of one template whose slots repeat in the same pattern differ in their values
only, and neither coverage nor consistency depends on the values: such items are one
class (``item_classes``), and a document is compared with classes.  So a benchmark of one
question in many versions gives one row a document, and one more for each version
that the document holds value by value.

A document that holds enough of a class's windows holds one of its rarest: of n windows of which
m must be found, one of any n - m + 1.  Documents and classes are joined on those first; all windows are
compared for the pairs that this leaves.

An item without windows of ``WINDOW`` template words (too short, or nearly all placeholders)
is looked up word by word instead, in windows of its own length if it is shorter, from
``LEAST_WORDS`` words on.

A fixed-size bitmap of the benchmark's window hashes goes to the tasks that read
documents; only windows that hit it become rows, and the join then decides
exactly.  The bitmap's size is bounded whatever the size of the benchmark.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.llm.words import WordTable, hash_bitmap, in_bitmap, kept_table, mixed, runs_of

WINDOW = 5

#: A window with fewer plain words than this is too general to compare.
LEAST_PLAIN = 3

#: Items without template windows are looked up word by word from this length on; shorter ones are
#: common phrases, and match a document that is just as short.
LEAST_WORDS = 4

#: Least share of an item's windows that a document must hold, and of slot values that must agree.
COVERAGE, CONSISTENCY = 0.5, 0.8

#: Alignments less than half a band apart share one of the two bands that overlap there.
BAND = 16

BITS = 24

#: Words read as numbers, and words read as units.
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
                "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred "
                "thousand million billion").split()
UNIT_WORDS = ("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons "
              "ounce ounces pound pounds ml l liter liters litre litres gallon gallons second seconds minute minutes "
              "hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent "
              "degree degrees mph kmh celsius fahrenheit meter meters metre metres kilometer kilometers").split()

PLAIN, NUMBER, NAME, UNIT = range(4)
NUMERAL = re.compile(r"[$€£+-]?\d[\d.,:/]*(?:[a-z]{1,3}|[%°€$])?")
EDGES = ".,;:!?\"'()[]{}<>*_|/\\"


FIXED = dict.fromkeys(NUMBER_WORDS, NUMBER) | dict.fromkeys(UNIT_WORDS, UNIT)


def described(raw: str) -> tuple[int, int, bool, bool]:
    """Of a word: hash, kind, begins with a capital, ends a sentence."""
    import xxhash

    word = raw.strip(EDGES)
    low = word.lower()
    kind = FIXED.get(low, NUMBER if NUMERAL.fullmatch(low) else PLAIN)
    return xxhash.xxh3_64_intdigest(low.encode("utf-8", "replace")), kind, word[:1].isupper(), not word or raw[-1] in ".!?:|\""


def word_table() -> WordTable:
    return WordTable(described, (np.uint64, np.int8, bool, bool))


def templates(texts: list[str], memo: WordTable):
    """Words of each text; over all texts in a row: template hashes, kinds, the place of each
    text's first word, and hashes of the words themselves."""
    words = [t.split() for t in texts]
    at = memo.numbers(list(chain.from_iterable(words)))
    raw, kinds, capital, ends = (column[at] for column in memo.columns)
    first = np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(np.int64)
    opens = np.concatenate([[True], ends[:-1]]) if len(at) else np.empty(0, bool)
    opens[first[:-1][first[:-1] < len(at)]] = True
    kinds = np.where((kinds == PLAIN) & capital & ~opens, np.int8(NAME), kinds)
    # placeholders hash by their kind alone
    return words, np.where(kinds == PLAIN, raw, mixed(kinds.astype(np.uint64))), kinds, first, raw


def slot(kind: int, word: str) -> str:
    return f"{kind}{word.strip(EDGES).lower()}"


def word_runs(raw: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of words as they stand; never those of template windows."""
    return mixed(runs_of(raw, size) ^ mixed(np.full(1, size, np.uint64)))


def windows(texts: list[str], memo: WordTable, window: int, hit=None, sizes: tuple[int, ...] = ()):
    """(text number, place, hash, slots) of every template window that ``hit`` lets through, and of
    the runs of ``sizes`` words.  A text with fewer words than a window is one window of its own length."""
    words, hashes, kinds, first, raw = templates(texts, memo)
    of = np.repeat(np.arange(len(texts)), np.diff(first))

    def within(size: int, n: int) -> np.ndarray:
        return np.flatnonzero(of[:n] == of[size - 1 :]) if n else np.empty(0, np.int64)

    def found(size: int, starts: np.ndarray, values: np.ndarray):
        plain = np.concatenate([[0], np.cumsum(kinds == PLAIN)])
        ok = plain[starts + size] - plain[starts] >= min(LEAST_PLAIN, size)
        if hit is not None:
            ok &= hit(values)
        for p, h in zip(starts[ok].tolist(), values[ok].view(np.int64).tolist(), strict=True):
            n = int(of[p])
            at = p - int(first[n])
            yield n, at, h, [slot(kinds[p + i], words[n][at + i]) for i in range(size) if kinds[p + i] != PLAIN]

    values = runs_of(hashes, window)
    starts = within(window, len(values))
    yield from found(window, starts, values[starts])
    for n, size in enumerate(np.diff(first).tolist()):
        if 0 < size < window:
            at = first[n : n + 1]
            yield from found(size, at, mixed(runs_of(hashes[at[0] : at[0] + size], size) + np.uint64(size)))
    for size in sizes:
        values = word_runs(raw, size)
        starts = within(size, len(values))
        values = values[starts]
        if hit is not None:
            starts, values = (x[hit(values)] for x in (starts, values))
        for p, h in zip(starts.tolist(), values.view(np.int64).tolist(), strict=True):
            yield int(of[p]), p - int(first[of[p]]), h, []


def digest(parts) -> str:
    """Of the slots of an item's windows, as ``contaminated`` makes it of a document's."""
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def item_windows(text: str, memo: WordTable, window: int, least_words: int):
    """(size, class, digest of the slots, [(place, hash, slots)]) of an item: of its template windows, and
    of its runs of ``size`` words where it has no template window of full length (size 0: templates).
    Slots are numbered by the first place of their value, alike in all items of a class."""
    (words,), hashes, kinds, _, raw = templates([text], memo)
    found = [f[1:] for f in windows([text], memo, window)]
    numbers: dict[str, int] = {}
    pattern = [numbers.setdefault(slot(k, w), len(numbers)) for k, w in zip(kinds.tolist(), words, strict=True) if k != PLAIN]
    if found:
        said = hashlib.blake2b(hashes.tobytes() + b"|" + repr(pattern).encode(), digest_size=8).digest()
        yield (0, int.from_bytes(said, "big", signed=True), digest(s for _, _, slots in found for s in slots),
               [(at, h, [f"{s[0]}#{numbers[s]}" for s in slots]) for at, h, slots in found])
    if len(words) >= least_words and (len(words) < window or not found):
        size = min(window, len(words))
        said = hashlib.blake2b(raw.tobytes(), digest_size=8, key=b"words").digest()
        values = word_runs(raw, size).view(np.int64).tolist()
        yield size, int.from_bytes(said, "big", signed=True), digest(()), [(at, h, []) for at, h in enumerate(values)]


def item_rows(items: DataFrame, window: int, least_words: int) -> DataFrame:
    """item_id, size, item_class, said (digest of its slots), place, h and slots of the windows of ``items``
    (item_id and text)."""
    import pyarrow as pa

    kind = f"item_id {items.schema['item_id'].dataType.simpleString()}"

    def rows(batches):
        memo = word_table()
        for batch in batches:
            out = [(n, size, group, said, *w) for n, t in enumerate(batch.column("text").to_pylist())
                   for size, group, said, every in item_windows(t or "", memo, window, least_words) for w in every]
            if out:
                n, *columns = zip(*out, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").take(pa.array(n, pa.int64()))] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["item_id", "size", "item_class", "said", "place", "h", "slots"])

    return items.select("item_id", "text").mapInArrow(
        rows, f"{kind}, size int, item_class long, said string, place int, h long, slots array<string>")


def text_rows(table: DataFrame, keys: list[str], text: str, window: int, bitmap, bits: int, sizes: tuple[int, ...]) -> DataFrame:
    """``keys`` of ``table`` with place, h and slots of the windows of its texts that hit the bitmap."""
    import pyarrow as pa

    kind = ", ".join(f"`{k}` {table.schema[k].dataType.simpleString()}" for k in keys)

    def rows(batches):
        memo = word_table()
        hit = lambda h: in_bitmap(bitmap.value, h, bits)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(text).to_pylist()]
                out = list(windows(texts, memo, window, hit, sizes))
                if out:
                    n, place, h, slots = zip(*out, strict=True)
                    which = pa.array(n, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(k).take(which) for k in keys]
                        + [pa.array(place, pa.int32()), pa.array(h, pa.int64()), pa.array(slots, pa.list_(pa.string()))],
                        names=[*keys, "place", "h", "slots"])

    return table.select(*keys, text).mapInArrow(rows, f"{kind}, place int, h long, slots array<string>")


def renamed_items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))


def item_classes(benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text",
                 window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """item_id and item_class, each pair once: the members of the classes that ``contaminated`` reports.  An
    id with several texts, or with a short one, can be in several classes; one without windows is in none."""
    rows = item_rows(renamed_items(benchmark, item_col, item_text_col), window, least_words)
    return rows.select("item_id", "item_class").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                 coverage: float = COVERAGE, consistency: float = CONSISTENCY, bits: int = BITS,
                 least_words: int = LEAST_WORDS) -> DataFrame:
    """Documents with the classes of benchmark items that they hold: doc_id, text_hash,
    item_id, coverage (share of the class's windows), consistency (share of slot
    values that agree, 1 without slots), exact (an alignment has every window with the values of
    ``item_id``), all of the occurrence that is exact, or else covers or agrees most; item_class and
    class_items (its number of ids).  A pair has a row for each ``item_id`` that is exact (the smallest of
    those that say the same), or else one with the smallest id of the class.

    Null and empty texts have no windows and match nothing; whole texts are read however long.  An item of
    fewer words than a window matches a document that is just as short; one of ``least_words`` words or more that
    is as short, or whose windows are nearly all placeholders, also matches any text that
    holds it word by word.  Rows of one item id with different texts each count, repeated rows of
    documents or items give one row; null ids are kept as they are, with the smallest id null only where
    all are; other columns are not read; empty tables give no pairs.
    """
    spark = docs.sparkSession
    items = kept_table(item_rows(renamed_items(benchmark, item_col, item_text_col), window, least_words), "items")
    sizes = tuple(sorted(r["size"] for r in items.where("size > 0").select("size").distinct().collect()))  # at most ``window``
    said = items.groupBy("item_class", "said").agg(F.min("item_id").alias("exact_item"))
    classes = items.groupBy("item_class").agg(F.min("item_id").alias("least_item"),
                                              F.count_distinct(F.struct("item_id")).alias("class_items"))
    held = items.select("item_class", "h", "place", "slots").distinct()
    bitmap = spark.sparkContext.broadcast(hash_bitmap(items, "h", bits))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("text_hash"),
                        F.col(text_col).alias("text"))
    hits = kept_table(text_rows(keyed, ["doc_id", "text_hash"], "text", window, bitmap, bits, sizes), "hits")

    # documents and classes that share one of the class's rarest windows
    often = hits.groupBy("h").agg(F.count("*").alias("often"))
    of_class = Window.partitionBy("item_class")
    ranked = (held.select("item_class", "h").distinct().join(often, "h", "left")
              .withColumn("rank", F.row_number().over(of_class.orderBy(F.coalesce("often", F.lit(0)), "h")))
              .withColumn("of", F.count("*").over(of_class)))
    rarest = ranked.where(F.col("rank") <= F.col("of") - F.ceil(F.col("of") * coverage - 1e-9) + 1).where("often is not null")
    pair = ["doc_id", "text_hash", "item_class"]
    candidates = hits.select("doc_id", "text_hash", "h").distinct().join(rarest.select("h", "item_class", "of"), "h").select(*pair, "of").distinct()

    # all windows of those
    theirs = held.withColumnRenamed("place", "item_place")
    wanted = candidates.join(theirs, "item_class").withColumnsRenamed({"doc_id": "its_doc", "text_hash": "its_text", "h": "its_h"})
    here = hits.withColumnRenamed("slots", "here")
    same = F.col("doc_id").eqNullSafe(F.col("its_doc")) & (F.col("text_hash") == F.col("its_text")) & (F.col("h") == F.col("its_h"))
    aligned = F.col("place") - F.col("item_place")
    occurrences = F.array(*(F.struct(F.lit(kind).alias("kind"), F.floor(at).cast("long").alias("at")) for kind, at in (
        (0, F.lit(0)), (1, aligned), (2, aligned / BAND), (3, (aligned + BAND // 2) / BAND))))
    values = F.expr("transform(arrays_zip(slots, here), x -> struct(x.slots as theirs, x.here as ours))")
    found = here.join(wanted, same).withColumn("occurrence", F.explode(occurrences)).groupBy(*pair, "of", "occurrence").agg(
        F.size(F.collect_set("h")).alias("windows"), F.array_distinct(F.flatten(F.collect_set(values))).alias("bound"),
        F.collect_set(F.when(F.col("occurrence.kind") == 1, F.struct("item_place", "here"))).alias("read"))
    share = F.when(F.size("bound") == 0, 1.0).otherwise(
        F.least(F.size(F.expr("array_distinct(bound.theirs)")), F.size(F.expr("array_distinct(bound.ours)"))) / F.size("bound"))
    read = F.when((F.col("occurrence.kind") == 1) & (F.col("windows") == F.col("of")),
                  F.sha2(F.concat_ws("\x1f", F.flatten(F.expr("array_sort(read).here"))), 256))
    enough = found.select(*pair, (F.col("windows") / F.col("of")).alias("coverage"), share.alias("consistency"), read.alias("said")).where(
        (F.col("coverage") >= coverage) & (F.col("consistency") >= consistency))
    enough = enough.join(said.withColumn("exact", F.lit(True)), ["item_class", "said"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    best = enough.groupBy(*pair).agg(F.max(F.struct("exact", "coverage", "consistency")).alias("best"),
                                     F.collect_set(F.when(F.col("exact"), F.struct(F.col("exact_item").alias("id")))).alias("items"))
    named = best.join(classes, "item_class").select(
        *pair, "class_items", "best", F.explode(F.when(F.size("items") > 0, F.col("items")).otherwise(
            F.array(F.struct(F.col("least_item").alias("id"))))).alias("item"))
    # an item with two classes is named once
    one = named.groupBy("doc_id", "text_hash", F.col("item.id").alias("item_id")).agg(
        F.max(F.struct("best", "item_class", "class_items")).alias("top"))
    return one.select("doc_id", "text_hash", "item_id", "top.best.coverage", "top.best.consistency", "top.best.exact",
                      "top.item_class", "top.class_items")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pairs of ``contaminated`` without their text_hash."""
    return contaminated(docs, benchmark).drop("text_hash")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the columns of ``docs``."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id"), "text_hash").distinct()
    keyed = docs.select(F.struct("*").alias("whole"), F.xxhash64("doc_id", "text").alias("key"))
    on = F.col("whole.doc_id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("text_hash"))
    return keyed.join(bad, on, "left_anti").select("whole.*")
