"""Substring deduplication by distributed prefix doubling (operator 3).

Every byte that is covered by a string of ``LENGTH`` bytes which also starts in a
document with a smaller id is removed.  Sorted ranks are replaced by fingerprints:
what is called a rank here is a 64-bit polynomial hash of 16, 33 or 50 bytes at a
sampled position.  Nothing is sorted, ranked again or doubled; Spark groups equal
fingerprints, and what is unique (met in one document alone) takes no part in the
next round.  Sorting (rank, rank at an offset) pairs of every byte would shuffle the
text many times over.  Equal fingerprints count as equal strings without a
comparison of bytes, so results are exact up to collisions of 64-bit hashes.

*Sampled positions.*  Doubling need not start at every byte.  Each window of
``LENGTH`` bytes has an anchor, the place of its least 16-byte rank; equal windows
have equal anchors, and consecutive windows mostly share one, so about one
position in 18 is an anchor.  The windows of one anchor are decided together.

*Chunks.*  Anchors whose rank has three zero bits cut a document into chunks of
windows (some 150 bytes).  A chunk that a document with a smaller id holds in
full is removed in full; only its first holder's takes part in rounds 2 and 3.

*Round 1, 16 bytes.*  Names of chunks with the first document that holds them; ranks of anchors that two
documents hold.
*Round 2, 33 bytes.*  An anchor's windows are dealt by their offset to it into groups of
eighteen; the windows of a group have 33 bytes in common, those around the anchor.
The anchor's rank extended by the ranks at the group's offsets names them, and a
group survives if two documents hold its name.
*Round 3, the threshold.*  A surviving group is sent with its bytes.  Equal
groups are one class with the smallest id that holds them; only where one 33-byte
name has several classes are their windows named one by one, and each window
goes to the smallest id that any class has for it.  Equal windows have equal names of
33 bytes, so the classes of one name are compared where they meet, in one task, and no row
is made of a window; the windows of a name with over ``TOGETHER`` classes are dealt out as rows.

Names of rounds 1 and 2 are not rows: a task sorts them and sends four bytes of each, those of one
bucket (the first bits) in one row.  What a round doesn't need is held back by filters of the surviving names,
with bits in proportion to these names, up to ``MOST_BITS``; a hit by chance costs a row and changes nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.llm.words import discard, kept_table, mixed, shuffles_dropped, small_batches

LENGTH, RANK, CUT_BITS = 50, 16, 3

#: Offsets of a group of windows.
GROUP = 18

#: Filters have 2^BITS bits at least, then as many as it takes for SLOTS bits a name, up to 2^MOST_BITS; round 1's two
#: up to half of that, as round 2 mends what they let through and a worker holds all three.
BITS, MOST_BITS, SLOTS = 27, 29, 8

#: Names are dealt by their first bits; of the others 32 are sent.
BUCKET_BITS = 12

#: Names that a task sorts and sends at once.
SENT_AT_ONCE = 1 << 20
LAST_ID = (1 << 63) - 1

#: Classes of one name that a task compares window by window.
TOGETHER = 1000

#: A text longer than this is read in segments that overlap by a window.
SEGMENT = 1 << 22

#: Bytes of texts that are read at once.
AT_ONCE = 1 << 16


class Ranks:
    """Names of stretches of bytes: polynomial hashes modulo 2^64 over random byte values, mixed."""

    BASE = 0xD1342543DE82EF95

    def __init__(self):
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.inverse = pow(self.BASE, -1, 1 << 64)
        self.powers, self.inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def read(self, data: np.ndarray) -> np.ndarray:
        """Sums from which ``of`` names stretches."""
        for name, base in (("powers", self.BASE), ("inverses", self.inverse)):
            have = getattr(self, name)
            while len(have) <= len(data):
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
            setattr(self, name, have)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((sums[b] - sums[a]) * self.inverses[a] + (b - a).astype(np.uint64))


def window_runs(data: np.ndarray, sizes: np.ndarray, ranks: Ranks, length: int, rank: int):
    """Runs of windows with one anchor, of texts of these sizes one behind the other: first window, window
    behind the last, anchor, the anchor's rank, the text; and the sums for further ranks.
    Windows don't cross texts."""
    n, width = len(data) - rank + 1, length - rank + 1
    sums = ranks.read(data)
    at = np.arange(n)
    h = mixed((sums[rank:] - sums[:n]) * ranks.inverses[:n])
    low = np.uint64((1 << 24) - 1)
    best, step = (h & ~low) | at.astype(np.uint64), 1
    while 2 * step <= width:
        best = np.minimum(best[: len(best) - step], best[step:])
        step *= 2
    rest = width - step
    if rest:
        best = np.minimum(best[: len(best) - rest], best[rest:])
    anchors = (best & low).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    behind = begin + sizes - length + 1  # the window behind a text's last
    new = np.append(True, anchors[1:] != anchors[:-1])
    new[begin] = new[behind[:-1]] = True
    first = np.flatnonzero(new)
    end, of = np.append(first[1:], len(best)), np.searchsorted(begin, first, "right") - 1
    within = first < behind[of]
    first, end, of = first[within], end[within], of[within]
    anchors = anchors[first]
    return first, end, anchors, h[anchors], of, sums


def chunk_runs(of: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places (among the runs) of the first run of each chunk; ``of``: the text of each run."""
    cut = (mixed(h) & np.uint64((1 << CUT_BITS) - 1)) == 0
    return np.flatnonzero(cut | (np.diff(of, prepend=-1) != 0))


def segments(text: bytes, length: int):
    """(offset, bytes) whose windows are together all windows of the text."""
    for at in range(0, len(text) - length + 1, SEGMENT):
        yield at, text[at : at + SEGMENT + length - 1]


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (a null id after all others), key (tells texts of one id apart) and t (bytes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(id_col).isNull().alias("no_id"),
                       F.xxhash64(id_col, text).alias("key"), F.encode(text, "UTF-8").alias("t"))


def name_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(3) + mixed(b))


class Segments:
    """Runs, chunks and groups of stretches of bytes, given as id, key, offset and bytes (a window at least)."""

    def __init__(self, stretches: list[tuple], ranks: Ranks, length: int, rank: int):
        ids, keys, offsets, parts = zip(*stretches, strict=True)
        self.raw, sizes = b"".join(parts), np.array([len(x) for x in parts], np.int64)
        self.ranks, self.length, self.rank = ranks, length, rank
        self.first, self.end, self.anchor, self.name, self.of, self.sums = window_runs(np.frombuffer(self.raw, np.uint8), sizes, ranks, length, rank)
        self.ids, self.keys = np.array(ids, np.int64), np.array(keys, np.int64)
        self.shift = np.array(offsets, np.int64) - (np.cumsum(sizes) - sizes)  # from places here to places in the text
        self.chunk = chunk_runs(self.of, self.name)  # first run of each chunk
        self.chunk_first, self.chunk_of = self.first[self.chunk], self.of[self.chunk]
        self.chunk_end = self.end[np.append(self.chunk[1:], len(self.first)) - 1]

    def chunk_names(self) -> np.ndarray:
        return self.ranks.of(self.sums, self.chunk_first, self.chunk_end + self.length - 1)

    def anchor_names(self) -> np.ndarray:
        """Ranks of anchors are small, as the least of their windows; their names are spread evenly."""
        return mixed(self.name + np.uint64(1))

    def groups(self, use: np.ndarray):
        """Of the runs ``use``: name of a group's common bytes, first window, the window
        behind the last, the anchor, and the stretch."""
        first, end, at, name, of = self.first[use], self.end[use], self.anchor[use], self.name[use], self.of[use]
        for near in range(0, self.length - self.rank + 1, GROUP):
            far = min(near + GROUP, self.length - self.rank + 1) - 1
            a, b = np.maximum(first, at - far), np.minimum(end, at - near + 1)
            ok = a < b
            o = at[ok]
            around = self.ranks.of(self.sums, o - near, o - far + self.length)
            yield name_pair(name[ok] + np.uint64(near), around), a[ok], b[ok], o, of[ok]


def read_segments(batches, length: int, rank: int):
    """For each batch of texts, what reads its ``Segments`` one after the other."""
    ranks = Ranks()

    def read_at_once(batch):
        stretches, size = [], 0
        for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "t")), strict=True):
            for at, part in segments(text, length):
                stretches.append((doc, key, at, part))
                size += len(part)
                if size >= AT_ONCE:
                    yield Segments(stretches, ranks, length, rank)
                    stretches, size = [], 0
        if stretches:
            yield Segments(stretches, ranks, length, rank)

    for batch in batches:
        yield read_at_once(batch)


def scanned(keyed: DataFrame, schema: str, length: int, rank: int, rows_of) -> DataFrame:
    """Columns that ``rows_of(segments)`` gives, joined over many texts."""
    import pyarrow as pa

    names = [part.split()[0] for part in schema.split(", ")]

    def joined(found):
        columns = []
        for column in zip(*found, strict=True):
            if isinstance(column[0], list):
                columns.append(pa.array([x for part in column for x in part], pa.binary()))
            else:
                columns.append(pa.array(np.concatenate(column)))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def scan(batches):
        found, size = [], 0
        for read in read_segments(batches, length, rank):
            for s in read:
                columns = rows_of(s)
                if len(columns[0]):
                    found.append(columns)
                    size += len(columns[0])
                if size > 50_000:
                    yield joined(found)
                    found, size = [], 0
        if found:
            yield joined(found)

    return keyed.select("id", "key", "t").mapInArrow(scan, schema)


NAMES, CHUNKS = 0, 1


def bucket_rows(kind: int, values: np.ndarray, names: np.ndarray):
    """A row for each bucket of sorted ``names``, with the bytes of its ``values``."""
    import pyarrow as pa

    bounds = np.append(np.searchsorted(names, np.arange(1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)), len(names))
    some = np.flatnonzero(np.diff(bounds))
    offsets = (np.append(bounds[some], len(names)) * values.strides[0]).astype(np.int32)
    blobs = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some.astype(np.int32)), blobs], names=["kind", "bucket", "blob"])


def once_a_text(names: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The names, each once for a text."""
    order = np.argsort(names, kind="stable")  # a text's equal names are neighbours then
    names, of = names[order], of[order]
    return names[np.append(True, (names[1:] != names[:-1]) | (of[1:] != of[:-1]))] if len(names) else names


def sent(names: list, chunks: list):
    """Rows of names, twice if they come oftener, and of chunks, each with the smallest id here."""
    if names:
        h = np.sort(np.concatenate(names))
        h = h[np.append(np.ones(min(2, len(h)), bool), h[2:] != h[:-2])]
        yield bucket_rows(NAMES, (h >> np.uint64(32 - BUCKET_BITS)).astype(np.uint32), h)
    if chunks:
        r, ids = (np.concatenate(c) for c in zip(*chunks, strict=True))
        order = np.lexsort((ids, r))
        order = order[np.append(True, r[order[1:]] != r[order[:-1]])]
        yield bucket_rows(CHUNKS, np.stack([r[order], ids[order].view(np.uint64)], axis=1), r[order])


def bucket_survivors(batches):
    """Of rows in the order of kind and bucket: 32 bits of the names that come twice, and of each chunk's with its smallest id."""
    import pyarrow as pa

    def surviving(kind, bucket, blobs):
        raw = b"".join(blobs)
        if kind == NAMES:
            h = np.sort(np.frombuffer(raw, np.uint32))
            low = np.unique(h[1:][h[1:] == h[:-1]])
        else:
            r, ids = np.frombuffer(raw, np.uint64).reshape(-1, 2).T
            order = np.lexsort((ids.view(np.int64), r))
            order = order[np.append(True, r[order[1:]] != r[order[:-1]])]
            low = (owner_keys(r[order], ids[order].view(np.int64)) & LOW).astype(np.uint32)
        return kind, bucket, len(low), low.tobytes()

    def joined(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                                          names=["kind", "bucket", "n", "blob"])

    at, blobs, rows, size = None, [], [], 0
    for batch in batches:
        for kind, bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "blob")), strict=True):
            if (kind, bucket) != at:
                if blobs:
                    rows.append(surviving(*at, blobs))
                    size += rows[-1][2]
                if size > SENT_AT_ONCE:
                    yield joined(rows)
                    rows, size = [], 0
                at, blobs = (kind, bucket), []
            blobs.append(blob)
    if blobs:
        rows.append(surviving(*at, blobs))
    if rows:
        yield joined(rows)


def surviving_names(keyed: DataFrame, length: int, rank: int, names_of, chunks_of=None) -> DataFrame:
    """Names that two documents hold, of ``names_of(segments)`` (names and their texts), and chunks with the smallest id that
    holds them, of ``chunks_of(segments)`` (names and ids): 32 bits of their keys by kind and bucket.
    Names that only texts of one id hold may be among them."""

    def scan(batches):
        names, chunks, size = [], [], 0
        for read in read_segments(batches, length, rank):
            for s in read:
                names.append(once_a_text(*names_of(s)))
                size += len(names[-1])
                if chunks_of:
                    chunks.append(chunks_of(s))
                if size > SENT_AT_ONCE:
                    yield from sent(names, chunks)
                    names, chunks, size = [], [], 0
        yield from sent(names, chunks)

    rows = keyed.select("id", "key", "t").mapInArrow(scan, "kind int, bucket int, blob binary")
    return rows.repartition("bucket").sortWithinPartitions("kind", "bucket").mapInArrow(bucket_survivors, "kind int, bucket int, n long, blob binary")


LOW = np.uint64((1 << 32) - 1)


def name_keys(names: np.ndarray) -> np.ndarray:
    """Bucket and 32 further bits."""
    return names >> np.uint64(32 - BUCKET_BITS)


def owner_keys(names: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bucket of the name and 32 bits of the name with an id."""
    return (names >> np.uint64(64 - BUCKET_BITS) << np.uint64(32)) | (with_id(names, ids) >> np.uint64(32))


def slots(keys: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The places of keys in a filter, in the piece of their bucket."""
    inside = bits - BUCKET_BITS
    return (keys >> np.uint64(32) << np.uint64(inside)) | (mixed(keys * np.uint64(5) + np.uint64(probe)) >> np.uint64(64 - inside))


def filter_of(survivors: DataFrame, kind: int, bits: int, most: int = MOST_BITS) -> tuple[np.ndarray, int, int]:
    """Filter of the keys of one kind (bitmap, bits and slots of a key), made by Spark bucket by bucket:
    at most 2^most / 8 bytes reach the driver, whatever the number of names."""
    import pyarrow as pa

    rows = survivors.where(F.col("kind") == kind)
    n = rows.agg(F.sum("n")).first()[0] or 0
    bits = max(bits, BUCKET_BITS + 3, min(most, (SLOTS * n).bit_length()))
    probes = max(1, min(3, (7 << bits) // (10 * max(n, 1))))
    each = 1 << (bits - BUCKET_BITS - 3)

    def pieces(batches):
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            out = []
            for bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "blob")), strict=True):
                keys = np.frombuffer(blob, np.uint32).astype(np.uint64) | (np.uint64(bucket) << np.uint64(32))
                piece = np.zeros(8 * each, np.uint8)
                for probe in range(probes):
                    piece[slots(keys, probe, bits) & np.uint64(8 * each - 1)] = 1
                out.append((bucket, np.packbits(piece, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary()), strict=True)], names=["bucket", "piece"])

    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows.select("bucket", "blob").mapInArrow(pieces, "bucket int, piece binary").collect():
        bitmap[row.bucket * each : (row.bucket + 1) * each] |= np.frombuffer(row.piece, np.uint8)
    return bitmap, bits, probes


def in_filter(which: tuple[np.ndarray, int, int], keys: np.ndarray) -> np.ndarray:
    bitmap, bits, probes = which
    at = np.arange(len(keys))
    for probe in range(probes):
        slot = slots(keys[at], probe, bits)
        at = at[(bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    out = np.zeros(len(keys), bool)
    out[at] = True
    return out


def with_id(names: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mixed(names ^ mixed(doc.astype(np.uint64)))


def repeats(keyed: DataFrame, length: int, rank: int, bits: int, together: int = TOGETHER) -> DataFrame:
    """Table of id, key and spans: a and b of the stretches to remove (overlapping ones included)."""
    import pyarrow as pa

    sc = keyed.sparkSession.sparkContext

    def first_round(s):
        return s.anchor_names(), s.of

    def chunks(s):
        return s.chunk_names(), s.ids[s.chunk_of]

    held = kept_table(surviving_names(keyed, length, rank, first_round, chunks), "round-1")
    anchors, owners = (sc.broadcast(filter_of(held, kind, bits, MOST_BITS - 1)) for kind in (NAMES, CHUNKS))
    discard(held)

    def open_runs(s):
        """Runs that two documents may hold, in chunks whose first holder theirs may be; those chunks."""
        mine = in_filter(owners.value, owner_keys(*chunks(s)))
        runs = np.flatnonzero(np.repeat(mine, np.diff(np.append(s.chunk, len(s.first)))))
        return runs[in_filter(anchors.value, name_keys(s.anchor_names()[runs]))], mine

    def second_round(s):
        pairs, _, _, _, of = zip(*s.groups(open_runs(s)[0]), strict=True)
        return np.concatenate(pairs), np.concatenate(of)

    alive = kept_table(surviving_names(keyed, length, rank, second_round), "round-2")
    pairs = sc.broadcast(filter_of(alive, NAMES, bits))
    discard(alive)

    def third_round(s):
        runs, mine = open_runs(s)
        # chunks that an earlier document holds: neighbours of one text are joined
        gone = np.flatnonzero(~mine)
        first = np.flatnonzero((np.diff(gone, prepend=-2) != 1) | (np.diff(s.chunk_of[gone], prepend=-1) != 0))
        last = np.append(first[1:], len(gone))[: len(first)] - 1
        a, b = s.chunk_first[gone[first]], s.chunk_end[gone[last]]
        parts = [(np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), a, b, s.chunk_of[gone[first]], [None] * len(a))]
        for pair, a, b, anchor, of in s.groups(runs):
            hit = in_filter(pairs.value, name_keys(pair))
            pair, a, b, anchor = pair[hit], a[hit], b[hit], anchor[hit]
            kind = name_pair(s.ranks.of(s.sums, a, b + s.length - 1), (anchor - a).astype(np.uint64))
            parts.append((pair.view(np.int64), kind.view(np.int64), a, b, of[hit],
                          [s.raw[i:j] for i, j in zip(a.tolist(), (b + s.length - 1).tolist(), strict=True)]))
        r, kind, a, b, of = (np.concatenate(c) for c in list(zip(*parts, strict=True))[:5])
        return (r, kind, s.ids[of], s.keys[of], a + s.shift[of], b + s.shift[of], [x for part in parts for x in part[5]])

    found = kept_table(scanned(keyed, "r long, kind long, id long, key long, a long, b long, bytes binary", length, rank, third_round), "round-3")
    for filtered in (anchors, owners, pairs):
        filtered.destroy()
    whole = found.where("bytes is null").select("id", "key", "a", F.expr(f"b + {length - 1}").alias("b"))
    groups = found.where("bytes is not null")
    classes = kept_table(groups.groupBy("r", "kind").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.first("bytes").alias("bytes")), "classes")
    crowded = kept_table(classes.groupBy("r").agg(F.count("*").alias("n")).where(F.col("n") > together).select("r"), "crowded-names")

    def decide(batches):
        """Of rows in the order of r: runs (j to k) of each class's windows whose smallest id m is below the class's largest."""
        ranks, rows, size = Ranks(), [], 0

        def decided_rows(r, kind, n, lo, hi, raw):
            lengths = np.array([len(x) for x in raw])
            data = np.frombuffer(b"".join(raw), np.uint8)
            many = lengths - length + 1
            of = np.repeat(np.arange(len(raw)), many)
            j = np.arange(len(of)) - (np.cumsum(many) - many)[of]
            at = (np.cumsum(lengths) - lengths)[of] + j
            _, name = np.unique(ranks.of(ranks.read(data), at, at + length), return_inverse=True)
            m = np.full(int(name.max()) + 1, LAST_ID)
            np.minimum.at(m, name, lo[of])
            m = m[name]
            use = np.flatnonzero((m < hi[of]) & (n > 1)[of])
            # runs of windows with one smallest id
            first = np.flatnonzero((np.diff(use, prepend=-2) != 1) | (j[use] == 0) | (np.diff(m[use], prepend=0) != 0))
            last = np.append(first[1:], len(use))[: len(first)] - 1
            first, last = use[first], use[last]
            sizes = np.bincount(of[first], minlength=len(raw))
            keep = np.flatnonzero((sizes > 0) | ((n == 1) & (lo < hi)))
            ends = np.append(0, np.cumsum(sizes[keep])).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(j[first]), pa.array(j[last]), pa.array(m[first])], names=["j", "k", "m"])
            each = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(n[keep] == 1, False)), runs)
            return pa.RecordBatch.from_arrays([pa.array(r[keep]), pa.array(kind[keep]), pa.array(lo[keep]), each], names=["r", "kind", "lo", "each"])

        def joined(ended):
            """What is decided of the rows whose names have no more rows to come, and the other rows."""
            columns = [np.concatenate(c) for c in zip(*(x[:5] for x in rows), strict=True)]
            raw = [x for part in rows for x in part[5]]
            cut = len(raw) if ended else int(np.argmax(columns[0] == columns[0][-1]))
            rest = [] if cut == len(raw) else [(*(c[cut:] for c in columns), raw[cut:])]
            return (decided_rows(*(c[:cut] for c in columns), raw[:cut]) if cut else None), rest

        for whole in batches:
            for batch in (whole.slice(at, 5000) for at in range(0, whole.num_rows, 5000)):
                rows.append((*(batch.column(c).to_numpy() for c in ("r", "kind", "n", "lo", "hi")), batch.column("bytes").to_pylist()))
                size += batch.num_rows
                if size >= 5000:
                    out, rows = joined(ended=False)
                    size = sum(len(x[5]) for x in rows)
                    if out is not None:
                        yield out
        if rows:
            yield joined(ended=True)[0]

    uncrowded = (classes.join(crowded, "r", "left_anti").withColumn("n", F.count("*").over(Window.partitionBy("r")))
                 .where("n > 1 or lo < hi").select("r", "kind", "n", "lo", "hi", "bytes").sortWithinPartitions("r"))
    each_type = "array<struct<j: long, k: long, m: long>>"
    decided = kept_table(uncrowded.mapInArrow(decide, f"r long, kind long, lo long, each {each_type}"), "decided")

    def name_windows(batches):
        ranks = Ranks()
        for batch in batches:
            out = []
            for r, kind, lo, raw in zip(*(batch.column(c).to_pylist() for c in ("r", "kind", "lo", "bytes")), strict=True):
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(len(data) - length + 1)
                names = ranks.of(ranks.read(data), at, at + length)
                out.append((np.full(len(at), r), np.full(len(at), kind), at, names.view(np.int64), np.full(len(at), lo)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["r", "kind", "j", "w", "lo"])

    crowd = classes.join(crowded, "r")
    windows = kept_table(crowd.select("r", "kind", "lo", "bytes").mapInArrow(
        name_windows, "r long, kind long, j long, w long, lo long"), "windows")
    first = windows.groupBy("w").agg(F.min("lo").alias("m"))
    per_class = windows.join(first, "w").groupBy("r", "kind").agg(F.collect_list(F.struct("j", F.col("j").alias("k"), "m")).alias("each"))
    dealt = kept_table(crowd.select("r", "kind", "lo", "hi").join(per_class, ["r", "kind"]).where("exists(each, x -> x.m < hi)")
                       .select("r", "kind", "lo", "each"), "dealt-windows")
    discard(classes, windows, crowded)
    decided_all = decided.unionByName(dealt)
    placed = groups.select("r", "kind", "id", "key", "a", "b").join(decided_all, ["r", "kind"])
    same = placed.where("each is null and lo < id").select("id", "key", "a", F.expr(f"b + {length - 1}").alias("b"))
    single = (placed.where("each is not null").select("id", "key", "a", F.explode(F.expr("filter(each, x -> x.m < id)")).alias("x"))
              .select("id", "key", F.expr("a + x.j").alias("a"), F.expr(f"a + x.k + {length}").alias("b")))
    spans = whole.unionByName(same).unionByName(single).groupBy("id", "key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    out = kept_table(spans, "spans")
    discard(found, decided, dealt)
    return out


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                     rank: int = RANK, bits: int = BITS, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that
    stay) of every row of ``docs``.

    Matches never cross rows.  Strings are judged on the input.  Null and empty texts
    and texts shorter than ``length`` keep all they have.  Rows that share an id are
    parts of one document and take nothing from each other; repeated rows are rows
    of their own with the same result.  A null id comes after all others.  Columns
    not named are not read; an empty table gives no rows.
    """
    import pyarrow as pa

    if not 0 < rank <= length - GROUP:
        raise ValueError(f"rank must be at most length - {GROUP}")
    keyed = keyed_texts(docs, id_col, text_col)
    with shuffles_dropped(docs.sparkSession), small_batches(docs.sparkSession, 1000):
        spans = repeats(keyed, length, rank, bits, together)
    joined = keyed.join(spans, ["id", "key"], "left").select("id", "no_id", "t", "spans.a", "spans.b")

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for doc, no, text, a, b in zip(*(part.column(c).to_pylist() for c in ("id", "no_id", "t", "a", "b")), strict=True):
                    doc = None if no else doc
                    if not a:
                        out.append((doc, len(text), 0, 0, text))
                        continue
                    steps = np.zeros(len(text) + 1, np.int32)
                    np.add.at(steps, a, 1)
                    np.add.at(steps, b, -1)
                    gone = np.cumsum(steps[:-1]) > 0
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    out.append((doc, len(text), len(text) - len(kept), int(gone[0]) + int(np.sum(gone[1:] & ~gone[:-1])), kept))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def substrings_digest(docs: DataFrame) -> DataFrame:
    """The result for every document with the SHA-256 of the kept bytes in their place."""
    return dedup_substrings(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
