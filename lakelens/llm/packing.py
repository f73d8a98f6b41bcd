"""Harmonic packing of token ids into fixed-length sequences (operator 10).

Every document's ids are cut into pieces whose lengths fall into classes of the
form capacity / k: whole sequences, halves, quarters and so on down to
``shortest``; what is left of a document (fewer than ``shortest`` ids) is one
more piece in the class of its exact length.  A bin of the class with pieces of
length s takes exactly capacity // s pieces.  Bins are filled by each task on
its own, so packing needs no shuffle and no task waits for another.

At the end of a task at most one bin a class is open.  An open bin of a
power-of-two class is closed as sequences of power-of-two length, which need no
padding; the open bins of the short classes are strung together and cut at the
capacity, so that one sequence a task is padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.words import remembered

CAPACITY, SHORTEST, END_ID = 2048, 32, 1

SCHEMA = ("doc_id {id}, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long")


class PieceIds(dict):
    """Ids (little-endian unsigned 32-bit) of the white-space delimited pieces of a
    text, A-Z lower-cased.  The tokenizer lower-cases and ends words at white space,
    so a text's ids are its pieces' ids in a row.  Special strings are matched as
    they are written; texts that may hold one are not lower-cased here.

    ``LIMIT`` pieces are remembered.  A piece that ends in common signs is looked up
    without them, and words of letters alone are encoded many in one call (each
    word's last id is one that ends words).
    """

    LIMIT = 700_000
    #: Signs that are a word of their own behind a letter (no apostrophe, nothing of special strings).
    SIGNS = b".,;:!?%$*#&-_/=+)]}\""

    def __init__(self, path: str):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def single(self, pieces: list[bytes]) -> list[bytes]:
        import numpy as np

        got = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are one run of letters each."""
        import numpy as np

        (got,) = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
        ids = np.array(got.ids, "<u4")
        last = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(last) != len(words):
            return self.single(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *last[:-1]], last, strict=True)]

    def learn(self, new: list[bytes]) -> None:
        signed, letters, other = [], set(), set()
        for p in new:
            core = p.rstrip(self.SIGNS)
            if b"a" <= core[-1:] <= b"z" and len(core) < len(p):  # signs are a word of their own
                ids, more = self.get(core), self.get(p[len(core) :])
                if ids is not None and more is not None:
                    self[p] = ids + more
                    continue
            if not core.isalpha():  # ASCII letters
                text = core.decode("utf-8", "replace")
                if not (text.isalpha() and text.lower().isalpha()):
                    other.add(p)
                    continue
            letters.add(core)
            if len(core) < len(p):
                signed.append((p, core, p[len(core) :]))
                other.add(p[len(core) :])
        for found, encode, n in ((letters, self.words, 1000), (other, self.single, 4096)):
            todo = [p for p in found if p not in self]
            for i in range(0, len(todo), n):
                self.update(zip(todo[i : i + n], encode(todo[i : i + n]), strict=True))
        for p, core, signs in signed:
            self[p] = self[core] + self[signs]

    def encode(self, texts: list[bytes], end_id: int) -> list[bytes]:
        """Ids of each text and its end."""
        import numpy as np

        # the mark is no UTF-8, so no text has it; its id is none of the tokenizer's
        if any(b"<|" in t for t in texts):
            texts = [t if b"<|" in t else t.lower() for t in texts]
            flat = b" \xff ".join([*texts, b""]).split()
        else:
            flat = b" \xff ".join([*texts, b""]).lower().split()
        self[b"\xff"] = b"\xff\xff\xff\xff"
        before = len(self)
        found = list(map(self.get, flat))
        missed = [i for i, ids in enumerate(found) if ids is None]
        new = {flat[i] for i in missed}
        self.learn(list(new))
        for i in missed:
            found[i] = self[flat[i]]
        # frequent pieces come early: those that come when the memory is full are not kept
        for p in [*islice(reversed(self), len(self) - before)] if before > self.LIMIT else [p for p in new if len(p) > 64]:
            del self[p]
        ids = np.frombuffer(bytearray(b"".join(found)), "<u4")
        ends = np.flatnonzero(ids == 0xFFFFFFFF)
        ids[ends] = end_id
        raw, cuts = ids.tobytes(), (4 * (ends + 1)).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class Bins:
    """One task's bins.  ``add`` and ``close`` yield (doc_id, start, length,
    ids, doc_tokens, sequence_id, offset) of finished sequences."""

    def __init__(self, task: int, capacity: int, shortest: int):
        self.capacity, self.shortest = capacity, shortest
        self.next_id = task << 40
        self.open: dict[int, list[tuple]] = {}

    def sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, ids, total, self.next_id, at
            at += len(ids) // 4
        self.next_id += 1

    def cuts(self, total: int) -> Iterator[int]:
        """Lengths of a document's pieces."""
        for _ in range(total // self.capacity):
            yield self.capacity
        rest, size = total % self.capacity, self.capacity // 2
        while size >= self.shortest:
            if rest >= size:
                yield size
                rest -= size
            size //= 2
        if rest:
            yield rest

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        for size in self.cuts(total):
            pieces = self.open.setdefault(size, [])
            pieces.append((doc, start, ids[4 * start : 4 * (start + size)], total))
            if len(pieces) == self.capacity // size:
                yield from self.sequence(self.open.pop(size))
            start += size

    def close(self) -> Iterator[tuple]:
        short: list[tuple] = []
        for size, pieces in sorted(self.open.items(), reverse=True):
            if size < self.shortest:
                short += pieces
                continue
            while pieces:
                n = 1 << (len(pieces).bit_length() - 1)
                yield from self.sequence(pieces[:n])
                pieces = pieces[n:]
        self.open = {}
        now, room = [], self.capacity
        for doc, start, ids, total in short:
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room :]
                now.append((doc, start, part, total))
                start, room = start + len(part) // 4, room - len(part) // 4
                if not room:
                    yield from self.sequence(now)
                    now, room = [], self.capacity
        if now:
            yield from self.sequence(now)


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, shortest: int = SHORTEST, end_id: int = END_ID) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids (binary), doc_tokens,
    sequence_id, offset.

    Each row of ``docs`` is a document of its own, repeated rows included; a
    null or empty text is the end id alone; a null id stays null; other columns
    are not read.  Very long texts are encoded whole, in one task each.  An empty table gives no rows.  ``capacity`` and ``shortest``
    are powers of two.
    """
    import pyarrow as pa

    if capacity & (capacity - 1) or shortest & (shortest - 1) or not 0 < shortest <= capacity:
        raise ValueError("capacity and shortest must be powers of two, shortest at most capacity")
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))
    schema = SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())

    def packed(batches):
        from pyspark import TaskContext

        encoder = remembered(("pieces", tokenizer_path), lambda: PieceIds(tokenizer_path))
        bins = Bins(TaskContext.get().partitionId(), capacity, shortest)
        kind = None

        def batch_of(found: list[tuple]):
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
            kinds = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist(), end_id), strict=True):
                    found += bins.add(doc, ids)
                if found:
                    yield batch_of(found)
        if found := list(bins.close()):
            yield batch_of(found)

    return rows.mapInArrow(packed, schema)


def packed_digest(packed: DataFrame) -> DataFrame:
    """The packed pieces with the CRC-32 of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
