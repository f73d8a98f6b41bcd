"""Jaccard self-join on word n-grams with adaptive multi-match prefixes (operator 5).

A document's set are its distinct n-grams, hashed.  Documents with equal sets are
one node; nodes link when 100 * intersection >= percent * union.

*Prefixes.*  N-grams are ordered rare first, by a fixed-size table of counts
over all documents.  Two linked sets share at least l of their first
n - ceil(n * percent / 100) + l n-grams.  Every set chooses its own l: a longer
prefix costs more postings, but a pair is only verified when it shares l n-grams
(the smaller of the two sets' l), so l grows with the estimated number of
candidates.

*Short lists* (an n-gram in the prefixes of at most ``SHORT`` sets) give pairs,
counted, filtered by size, position and number of matches, and verified.

*Long lists* never give all their pairs.  Each has a centre c, the n-grams that more than half
of (some of) its members hold; it need not be a document.  S(x), the n-grams that x and c
don't share, decides the rest exactly.  With d = (100 - percent) / (100 + percent), x and y link when
|S(x) ^ S(y)| <= d (|x| + |y|).  Let f(x) = |S(x)| - d |x|, and let o be the member with
the least f.

* If f(x) + f(o) <= 0 then |x ^ o| <= |S(x)| + |S(o)| <= d (|x| + |o|): x and o link, and no
  comparison is needed.  Such members are near.  If S(x) and S(y) are disjoint and
  x and y link, f(x) + f(y) <= 0, so both are near.
* Otherwise they share an n-gram of S(x) and S(y), at least (f(x) + f(y)) / 2 of them, and again a
  prefix of each will do.  Two near members needn't be found.

S(x) is ordered by how many members differ from c in the same way, counted where more than a 64th
of them do.  The prefixes are postings under (c, n-gram)
and the lists of the next level, where size, place and shared differences filter pairs again;
lists without a far member, or of far ones that only look for near ones, have no pairs and go.
Fewer than half of the members (as far as the ones looked at tell) differ from c at an
n-gram, so lists halve from level to level; the levels end when no long list is left.

Components come from alternating large and small stars.  All state lives in
tables in the shared folder; what reaches the driver is the table of counts and
bitmaps of fixed size.  Keys with many rows (long lists, centres, hubs) are joined by a
broadcast of at most 1,000 of them or dealt out by a salt.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.words import WordHashes, discard, hash_bitmap, in_bitmap, join_facts, kept_table, mixed, remembered, runs_of, small_batches

WORDS, PERCENT = 3, 90
SHORT, MOST_MATCHES = 32, 4

#: Parts that the members compared with one centre are dealt to, and members that a centre is made from.
SALTS, VOTERS = 16, 33

#: Sides of a list: members that meet all others, and members near the centre or far from it that only meet the other side.
ALL, NEAR, FAR = 0, 1, 2

#: Counters of the n-gram counts (2^22), in blocks of 2^14, and bits of the prefilters.
COUNT_BITS, BLOCK_BITS, BITS = 22, 14, 26


def shingles(text: bytes | None, k: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of k words; all words as one if there are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = memo.of(words)
    return np.unique(runs_of(h, k)) if len(h) >= k else mixed(runs_of(h, len(h)) + np.uint64(len(h)))


def slots(h: np.ndarray) -> np.ndarray:
    """Counters of n-grams: low bits.  Prefixes hold n-grams of low counters, and the prefilters,
    by high bits, must not have them close together."""
    return (h & np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def packed(block: np.ndarray) -> bytes:
    import zlib

    return zlib.compress(narrow(block).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    import zlib

    flat = zlib.decompress(raw)
    return np.frombuffer(flat, f"u{len(flat) >> BLOCK_BITS}").astype(np.int64)


def only(rows: DataFrame, column: str, bitmap: np.ndarray, bits: int) -> DataFrame:
    """The rows whose 64-bit hash in ``column`` the bitmap has."""
    import pyarrow as pa

    given = rows.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(given.value, batch.column(column).to_numpy().view(np.uint64), bits)))

    return rows.mapInArrow(scan, rows.schema)


def node_of(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def rare_first(rest: np.ndarray, usual: np.ndarray, members: np.ndarray) -> np.ndarray:
    """N-grams in the order of the members that have them; ``usual``: sorted, those that more than a few have."""
    if not len(usual) or not len(rest):
        return rest
    at = np.minimum(np.searchsorted(usual, rest), len(usual) - 1)
    return rest[np.lexsort((rest, np.where(usual[at] == rest, members[at], 0)))]


def list_sizes(postings: DataFrame, short: int) -> DataFrame:
    """Table of key, size and long of the lists that have pairs to compare.  A list is long if it is
    larger than ``short`` and its pairs are more than those of lists of that size with as many members."""
    near, far = F.count_if(F.col("side") == NEAR), F.count_if(F.col("side") == FAR)
    every = F.count_if(F.col("side") == ALL)
    pairs = F.expr("every * (every - 1) / 2 + near * far")
    return (postings.groupBy("key").agg(F.count("*").alias("size"), every.alias("every"), near.alias("near"), far.alias("far"))
            .where(pairs > 0).select("key", "size", ((F.col("size") > short) & (2 * pairs > short * F.col("size"))).alias("long")))


def prefix_of(s: np.ndarray, counts: np.ndarray, usual: float, percent: int) -> tuple[np.ndarray, int]:
    """A set's prefix and the number of n-grams that its pairs must share there.
    ``usual``: the mean of the counts, which n-grams of no weight share a slot with."""
    n = len(s)
    least = -(-percent * n // 100)
    many = counts[slots(s)]
    order = np.lexsort((s, many))[: n - least + MOST_MATCHES]
    s, cost = s[order], np.cumsum(1 + np.maximum(many[order] - usual, 0))
    best, matches = None, 1
    for m in range(1, min(MOST_MATCHES, least) + 1):
        found = cost[n - least + m - 1]
        spent = found + 8 * found / m
        if best is None or spent < best:
            best, matches = spent, m
    return s[: n - least + matches], matches


def texts_of(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))


def described(docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, np.ndarray]:
    """Table of id, text_hash, n and node of every row; counts of all sets' n-grams by slot."""
    import pyarrow as pa

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("text_hash"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    block = 1 << BLOCK_BITS

    def scan(batches):
        memo = remembered("words", WordHashes)
        counts = np.zeros(1 << COUNT_BITS, np.int32)
        kind = None
        names = ["doc_id", "text_hash", "n", "node", "block", "counts"]
        for whole in batches:
            kind = whole.schema.field("doc_id").type
            for batch in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
                sets = [shingles(t, k, memo) for t in batch.column("t").to_pylist()]
                np.add.at(counts, slots(np.concatenate(sets)), np.int32(1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(map(node_of, sets), pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names=names)
        if kind is not None:
            parts = [(i, packed(counts[i * block : (i + 1) * block])) for i in range(len(counts) // block)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(parts), kind), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.binary()),
                 pa.array([i for i, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names=names)

    def add_up(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = unpacked(raw)
                total[i] = total[i] + part if i in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(map(packed, total.values()), pa.binary())],
                                             names=["block", "counts"])

    with small_batches(docs.sparkSession, 1000):
        table = kept_table(rows.mapInArrow(scan, f"doc_id {id_type}, text_hash long, n long, node binary, block int, counts binary"), "sets")
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    parts = table.where("block is not null").select("block", "counts").repartition("block").mapInArrow(add_up, "block int, counts binary")
    for r in parts.collect():  # 2^COUNT_BITS numbers in all
        counts[r.block * block : (r.block + 1) * block] = unpacked(bytes(r.counts))
    sets = kept_table(table.where("block is null").select("doc_id", "text_hash", "n", "node"), "nodes")
    discard(table)
    return sets, narrow(counts)


def from_sets(texts: DataFrame, k: int, schema: str, rows_of) -> DataFrame:
    """Rows that ``rows_of(node, set)`` gives for the sets of all texts, once for the
    equal sets of 1,000 rows.  ``rows_of`` returns columns."""
    import pyarrow as pa

    def scan(batches):
        memo = remembered("words", WordHashes)
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            seen: set[bytes] = set()
            found = []
            for t in batch.column("t").to_pylist():
                s = shingles(t, k, memo)
                node = node_of(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    if (columns := rows_of(node, s)) is not None:
                        found.append(pa.RecordBatch.from_pydict(columns))
                if len(found) >= 500:
                    yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]
                    found = []
            if found:
                yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]

    return texts.mapInArrow(scan, schema)


def prefix_postings(docs: DataFrame, table: DataFrame, text_col: str, k: int, percent: int, counts: np.ndarray, bits: int) -> DataFrame:
    """Table of key (n-gram), node, n, matches and place of the prefixes, n-grams that
    are in the prefix of one node alone left out; ``rank`` is the length of the prefix.
    ``table`` (of ``described``) says which nodes several rows have; only their prefixes are
    looked through for equal nodes."""
    import pyarrow as pa

    sc = docs.sparkSession.sparkContext
    given, usual = sc.broadcast(counts), float(counts.mean())
    copied = table.where("n > 0").groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1")
    several = sc.broadcast(hash_bitmap(copied.select(F.xxhash64("node").alias("h")), "h", bits))

    def prefix(node, s):
        import xxhash

        head, matches = prefix_of(s, given.value, usual, percent)
        h = np.array([xxhash.xxh64_intdigest(node, seed=42)], np.uint64)  # Spark's xxhash64
        return {"node": pa.array([node], pa.binary()), "n": pa.array([len(s)], pa.int64()), "matches": pa.array([matches], pa.int32()),
                "head": pa.array([head.tobytes()], pa.binary()), "several": pa.array(in_bitmap(several.value, h, bits))}

    with small_batches(docs.sparkSession, 1000):
        every = kept_table(from_sets(texts_of(docs, text_col), k, "node binary, n long, matches int, head binary, several boolean", prefix), "prefixes")
    once = kept_table(every.where("several").dropDuplicates(["node"]), "copied-prefixes")
    heads = every.where("not several").unionByName(once).drop("several")

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], names=["key"])

    met = heads.select("head").mapInArrow(keys, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    bitmap = sc.broadcast(hash_bitmap(met, "key", bits))

    def postings(batches):
        for batch in batches:
            parts = [np.frombuffer(h, np.uint64) for h in batch.column("head").to_pylist()]
            sizes = np.array([len(h) for h in parts], np.int64)
            flat = np.concatenate([np.empty(0, np.uint64), *parts])
            at = np.flatnonzero(in_bitmap(bitmap.value, flat, bits))
            of = np.repeat(np.arange(len(parts)), sizes)[at]
            which = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[at].view(np.int64)), batch.column("node").take(which), batch.column("n").take(which),
                 batch.column("matches").take(which), pa.array((at - (np.cumsum(sizes) - sizes)[of]).astype(np.int32)),
                 pa.array(sizes[of].astype(np.int32)), pa.array(np.full(len(at), ALL, np.int32))],
                names=["key", "node", "n", "matches", "place", "rank", "side"])

    found = kept_table(heads.mapInArrow(postings, "key long, node binary, n long, matches int, place int, rank int, side int"), "postings")
    discard(every, once)
    return found


def sets_of(docs: DataFrame, id_col: str, text_col: str, k: int, table: DataFrame, nodes: DataFrame, listed: DataFrame, bits: int) -> DataFrame:
    """Table of node, s (its n-grams) and in_long of the given nodes; in_long: they are among ``listed``,
    those of long lists.  ``table`` (of ``described``) says which rows have them; other texts aren't cut
    into n-grams again."""
    import pyarrow as pa

    rows = table.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("h"))
    bitmap = docs.sparkSession.sparkContext.broadcast(hash_bitmap(rows, "h", bits))
    texts = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))

    def scan(batches):
        memo = remembered("words", WordHashes)
        for batch in batches:
            hit = np.flatnonzero(in_bitmap(bitmap.value, batch.column("h").to_numpy().view(np.uint64), bits))
            for at in range(0, len(hit), 500):
                sets = [shingles(t, k, memo) for t in batch.column("t").take(pa.array(hit[at : at + 500])).to_pylist()]
                sets = {node_of(s): s for s in sets if len(s)}
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.binary()), pa.array([s.tobytes() for s in sets.values()], pa.binary())],
                                                 names=["node", "s"])

    found = texts.mapInArrow(scan, "node binary, s binary")
    marked = listed.distinct().withColumn("in_long", F.lit(True))
    with small_batches(docs.sparkSession, 1000):
        return kept_table(found.groupBy("node").agg(F.first("s").alias("s")).join(marked, "node", "left"), "set-members")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Table of the pairs x, y that link, as u, v."""
    import pyarrow as pa

    def scan(batches):
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            linked = []
            for sx, sy in zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist(), strict=True):
                a, b = np.frombuffer(sx, np.uint64), np.frombuffer(sy, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * shared >= percent * (len(a) + len(b) - shared))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(keep), batch.column("y").filter(keep)], names=["u", "v"])

    left = sets.select(F.col("node").alias("x"), F.col("s").alias("sx"))
    right = sets.select(F.col("node").alias("y"), F.col("s").alias("sy"))
    rows = pairs.join(left, "x").join(right, "y").select("x", "y", "sx", "sy")
    with small_batches(pairs.sparkSession):
        return kept_table(rows.mapInArrow(scan, "u binary, v binary"), "links")


def pairs_of(postings: DataFrame, sizes: DataFrame, percent: int, longs: DataFrame | None) -> DataFrame:
    """Table of the pairs x, y of short lists that size, place and matches leave.  ``longs``: the long lists' number
    for each node, for postings of whole sets; None for those of differences, which have ``rank`` n-grams."""
    little = postings.join(sizes.where(~F.col("long")), "key")
    a, b = little.alias("a"), little.alias("b")
    smaller, larger = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    of = "n" if longs is not None else "rank"
    # most n-grams that the pair can share: those up to this one, and those behind it
    most = F.least("a.place", "b.place") + 1 + F.least(F.col(f"a.{of}") - 1 - F.col("a.place"), F.col(f"b.{of}") - 1 - F.col("b.place"))
    fits = (F.col("a.node") < F.col("b.node")) & (smaller * 100 >= larger * percent) & (F.col("a.side") + F.col("b.side")).isin(ALL, NEAR + FAR)
    both = F.col("a.n") + F.col("b.n")
    if longs is not None:
        enough = most * (100 + percent) >= both * percent
    else:
        enough = (F.col("a.rank") + F.col("b.rank") - 2 * most) * (100 + percent) <= both * (100 - percent)
    met = (a.join(b, (F.col("a.key") == F.col("b.key")) & fits & enough)
           .groupBy(F.col("a.node").alias("x"), F.col("b.node").alias("y"))
           .agg(F.count("*").alias("shared"), F.first(F.least("a.matches", "b.matches")).alias("matches")))
    if longs is not None:  # a pair may share n-grams whose lists are long; differences are found by one
        met = (met.join(longs.select(F.col("node").alias("x"), F.col("longs").alias("lx")), "x", "left")
               .join(longs.select(F.col("node").alias("y"), F.col("longs").alias("ly")), "y", "left")
               .where(F.col("shared") >= F.col("matches") - F.least(F.coalesce("lx", F.lit(0)), F.coalesce("ly", F.lit(0)))))
    return kept_table(met.select("x", "y"), "pairs")


def centred(big: DataFrame, sizes: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of the long lists' centres (c, p: its n-grams, members, many) and of their members (node, c).
    Lists with equal centres are one."""
    import pyarrow as pa

    def majority(batches):
        key, voters, found = None, [], []

        def voted():
            grams, votes = np.unique(np.concatenate([np.frombuffer(v, np.uint64) for v in voters]), return_counts=True)
            grams = grams[2 * votes > len(voters)]
            return key, node_of(grams), grams.tobytes()

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                              names=["jury", "c", "p"])

        for batch in batches:
            for k, s in zip(batch.column("jury").to_pylist(), batch.column("s").to_pylist(), strict=True):
                if voters and k != key:
                    found.append(voted())
                    voters = []
                    if len(found) >= 100:
                        yield batch_of()
                        found = []
                key = k
                voters.append(s)
        if voters:
            found.append(voted())
        if found:
            yield batch_of()

    # lists with the same voters have one centre, and the voters' sets are read for it once
    picked = big.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(VOTERS)).alias("seat")).agg(F.min("node").alias("node"))
    juries = picked.groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))  # at most VOTERS nodes a key
    juries = kept_table(juries.withColumn("jury", F.xxhash64("nodes")), "juries")
    voters = juries.groupBy("jury").agg(F.first("nodes").alias("nodes")).select("jury", F.explode("nodes").alias("node"))
    voters = voters.join(sets, "node").select("jury", "s").repartition("jury").sortWithinPartitions("jury")
    with small_batches(big.sparkSession):
        centres = kept_table(voters.mapInArrow(majority, "jury long, c binary, p binary"), "centres")
    lists = kept_table(juries.select("key", "jury").join(centres.select("jury", "c"), "jury").join(sizes, "key").select("key", "c", "size"), "centred-lists")
    discard(juries)
    total = lists.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    members = kept_table(join_facts(big, lists, "key", "size", total).select("node", "c").distinct(), "members")
    one = (centres.groupBy("c").agg(F.first("p").alias("p"))
           .join(lists.groupBy("c").agg(F.max("size").alias("members")), "c")
           .join(members.groupBy("c").agg(F.count("*").alias("many")), "c"))
    out = kept_table(one, "centre-sets")
    discard(centres, lists)
    return out, members


def next_level(big: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Of the long lists: table of the links (u, v) of near members, and table of the postings of differences."""
    import pyarrow as pa

    centres, members = centred(big, sizes, sets)

    def differ(batches):
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            n, rank, rest = [], [], []
            for s, p in zip(*(batch.column(c).to_pylist() for c in ("s", "p")), strict=True):
                a = np.frombuffer(s, np.uint64)
                r = np.setxor1d(a, np.frombuffer(p, np.uint64), assume_unique=True)
                n.append(len(a))
                rank.append(len(r))
                rest.append(r.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("node"), pa.array(n, pa.int64()), pa.array(rank, pa.int64()),
                                              pa.array(rest, pa.binary())], names=["c", "node", "n", "rank", "rest"])

    # a centre's set goes to its members in parts
    dealt = members.join(sets, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    parts = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = dealt.join(parts.select("c", "salt", "p").hint("merge"), ["c", "salt"]).select("c", "node", "s", "p")
    with small_batches(big.sparkSession):
        apart = kept_table(rows.mapInArrow(differ, "c binary, node binary, n long, rank long, rest binary"), "differences")

    def counted(batches):
        for batch in batches:
            by: dict[bytes, list] = {}
            for c, rest in zip(*(batch.column(x).to_pylist() for x in ("c", "rest")), strict=True):
                by.setdefault(c, []).append(np.frombuffer(rest, np.int64))
            for c, parts in by.items():
                grams, many = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(grams), pa.binary()), pa.array(grams), pa.array(many)], names=["c", "gram", "many"])

    # what over a 64th of a centre's members have: at most 64 times the mean of their differences
    with small_batches(big.sparkSession, 5000):
        held = apart.select("c", "rest").mapInArrow(counted, "c binary, gram long, many long").groupBy("c", "gram").agg(F.sum("many").alias("many"))
        held = held.join(centres.select("c", F.greatest(F.lit(4), F.col("many") / 64).alias("few")), "c").where(F.col("many") > F.col("few"))
        usual = kept_table(held.groupBy("c").agg(F.collect_list("gram").alias("grams"), F.collect_list("many").alias("holders")), "usual-differences")
    # f, times 100 + percent to stay whole
    f = F.col("rank") * (100 + percent) - F.col("n") * (100 - percent)
    least = apart.groupBy("c").agg(F.min(F.struct(f.alias("f"), F.col("node"))).alias("o"), F.count("*").alias("many"))
    least = kept_table(least.select("c", F.col("o.f").alias("fo"), F.col("o.node").alias("o"), "many"), "least")
    total = least.agg(F.coalesce(F.sum("many"), F.lit(0)).alias("n")).first().n
    known = join_facts(apart.withColumn("f", f), least, "c", "many", total)
    near = known.where((F.col("f") + F.col("fo") <= 0) & (F.col("node") != F.col("o")))
    links = kept_table(near.select(F.col("node").alias("u"), F.col("o").alias("v")), "links")

    def prefixes(batches, met=None):
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            keys, of, places, sides = [], [], [], []
            grams, holders = (batch.column(x) for x in ("grams", "holders"))
            begin, flat, held_by = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64), holders.values.to_numpy()
            sorted_of: dict[bytes, tuple] = {}
            for i, (c, n, rank, f, fo, raw) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("c", "n", "rank", "f", "fo", "rest")), strict=True)):
                if c not in sorted_of:
                    g, m = flat[begin[i] : begin[i + 1]], held_by[begin[i] : begin[i + 1]]
                    order = np.argsort(g)
                    sorted_of[c] = g[order], m[order]
                rest = rare_first(np.frombuffer(raw, np.uint64), *sorted_of[c])
                any_one = -(-(rank * percent - n * (100 - percent)) // percent)  # whatever the partner's size
                half = lambda x: -(-x // (2 * (100 + percent)))
                for least, side in ((half(f - fo), NEAR),) if f + fo <= 0 else ((half(f + abs(fo)), ALL), (half(f + min(fo, 0)), FAR)):
                    head = rest[: max(0, rank - max(1, any_one, least) + 1)]
                    if side == FAR and fo > 0:  # nobody is near
                        continue
                    salt = np.frombuffer(c[:8], np.uint64)[0] ^ np.uint64(0 if side == ALL else 0x51ED270B153A4D2F)
                    key, place = mixed(head ^ salt), np.arange(len(head), dtype=np.int32)
                    if met is not None:
                        hit = in_bitmap(met.value, key, bits)
                        key, place = key[hit], place[hit]
                    keys.append(key)
                    of.append(np.full(len(key), i))
                    places.append(place)
                    sides.append(np.full(len(key), side, np.int32))
            if keys:
                at = np.concatenate(of)
                which = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), batch.column("node").take(which), batch.column("n").take(which),
                     pa.array(np.ones(len(at), np.int32)), pa.array(np.concatenate(places)), batch.column("rank").take(which).cast(pa.int32()),
                     pa.array(np.concatenate(sides))], names=["key", "node", "n", "matches", "place", "rank", "side"])

    # near members only meet far ones: they have postings under the far ones' keys alone
    schema = "key long, node binary, n long, matches int, place int, rank int, side int"
    salted = known.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    usual_parts = usual.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = salted.join(usual_parts.hint("merge"), ["c", "salt"], "left").select("c", "node", "n", "rank", "f", "fo", "rest", "grams", "holders")
    is_near = F.col("f") + F.col("fo") <= 0
    with small_batches(big.sparkSession):
        postings = kept_table(rows.where(~is_near).mapInArrow(prefixes, schema), "postings")
    asked = hash_bitmap(postings.where(F.col("side") == FAR), "key", bits)
    if asked.any():
        met = big.sparkSession.sparkContext.broadcast(asked)
        with small_batches(big.sparkSession):
            both = postings.unionByName(rows.where(is_near).mapInArrow(lambda batches: prefixes(batches, met), schema))
            far, postings = postings, kept_table(both, "postings")
        discard(far)
    discard(centres, members, apart, least, usual)
    return links, postings


def links(docs: DataFrame, table: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT,
          counts: np.ndarray, short: int = SHORT, bits: int = BITS) -> DataFrame:
    """Links (u, v) between nodes, enough to connect every component."""
    postings = prefix_postings(docs, table, text_col, k, percent, counts, bits)
    found, sets, members = [], None, None
    while postings is not None:
        sizes = kept_table(list_sizes(postings, short), "lists")
        total, any_long = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.bool_or("long"), F.lit(False))).first()
        in_long = only(postings.select("key", "node"), "key", hash_bitmap(sizes.where("long"), "key", bits), bits)
        big = kept_table(join_facts(in_long, sizes.where("long"), "key", "size", total).select("key", "node"), "long-lists")
        longs = big.groupBy("node").agg(F.count("*").alias("longs")) if sets is None else None
        pairs = pairs_of(postings, sizes, percent, longs)
        if sets is None:
            nodes = pairs.select(F.explode(F.array("x", "y")).alias("node")).unionByName(big.select("node"))
            sets = members = sets_of(docs, id_col, text_col, k, table, nodes, big.select("node"), bits)
        found.append(verified(pairs, members, percent))
        discard(postings, pairs)
        postings = None
        if any_long:
            # members of later lists are among those of the first long ones
            members = sets.where("in_long").select("node", "s")
            near, postings = next_level(big, sizes, members, percent, bits)
            found.append(near)
        discard(sizes, big)
    discard(sets)
    out = found[0]
    for more in found[1:]:  # two a level
        out = out.unionByName(more)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every linked node but the roots."""
    edges = kept_table(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before, total = None, 2 * edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("many"))
        large = join_facts(both, least, "u", "many", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many"))
        small = join_facts(large, down, "u", "many", total)
        old = edges
        edges = kept_table(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                           .unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        total = 2 * now[0]
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT,
                short: int = SHORT, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component), n_linked
    (rows of the component) and text_hash (of id and text) of every row of ``docs``.

    Null texts and texts without words have no n-grams and link with nothing; a
    text with fewer than ``k`` words is one n-gram.  Repeated rows and equal texts
    are in one component.  A null id never is the smallest; a component of null
    ids only has a null component_id.  Very long texts are cut into n-grams whole, in
    one task each.  Columns not named are not read; an empty table gives no rows.
    """
    table, counts = described(docs, id_col, text_col, k)
    joined = components(links(docs, table, id_col=id_col, text_col=text_col, k=k, percent=percent, counts=counts, short=short, bits=bits))
    nodes = table.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    rooted = nodes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("n_linked"))
    classes = kept_table(rooted.join(roots, "root").select("node", "component_id", "n_linked"), "classes")
    linked = table.where("n > 0").join(classes, "node").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_linked", "text_hash")
    alone = table.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                        F.lit(1).cast("long").alias("n_linked"), "text_hash")
    return linked.unionByName(alone)


def without_near_copies(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their component: one of each
    component, unless rows share that id.  Columns are those of ``docs``."""
    groups = near_groups(docs, k=k, percent=percent)
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    keyed = docs.select(F.struct("*").alias("whole"), F.xxhash64("doc_id", "text").alias("here"))
    on = F.col("whole.doc_id").eqNullSafe(F.col("gone_id")) & (F.col("here") == F.col("gone_hash"))
    return keyed.join(gone.hint("merge"), on, "left_anti").select("whole.*")
