"""Token counts by a compiled finite-state transducer (operator 1).

The tokenizer file's rules become one deterministic transducer over characters
that annotates each transition with the number of tokens it emits:

* word boundaries (letters, single digits, other signs, contractions, special
  strings) are a small automaton with a bounded look-behind;
* inside a word, byte-pair merging is compiled through a property of its
  results: a row of tokens is what merging gives exactly when every two
  neighbours stay apart when merged alone.  The last token of a prefix thus
  follows from the last tokens of its shorter prefixes, so a state is the last
  tokens of the most recent prefixes with their token counts, and a transition
  is annotated with the change of the count (which can be negative, when a
  longer token takes the place of several).

States and transitions are made when first met and remembered.

A text is cut into chunks at arbitrary bytes.  White space brings the transducer
to its start state from any state, so a chunk's state map is: the bytes before
the first white space (to be read from whatever state the chunk is entered in),
the tokens emitted after it, and the bytes after the last white space (which
say in what state the chunk is left).  Maps compose by joining one chunk's tail
to the next one's head, which is associative; the composition over a document
is a prefix scan over its chunks (a window sum numbers the stretches between
white space, whose parts then meet and are counted).
"""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.llm.words import remembered

#: Bytes of a chunk; a document of any length is cut into such chunks.
CHUNK = 1 << 16

#: Transitions, words and pairs that a worker remembers of each kind.
REMEMBERED = 1 << 19

#: Contractions that the tokenizer splits off, by the letters after the apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Signs that are a word of their own behind a letter.
SIGNS = b".,;:!?%$*#&-_/=+)]}\""

START = -1


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Remembered(dict):
    def keep(self, key, value):
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value
        return value


class MergeTransducer:
    """Counts the tokens of one word (bytes) of a byte-pair vocabulary with word ends."""

    def __init__(self, merges: list, vocab: dict, ending: str):
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(merges)}
        self.ending = ending
        self.inner = {t for t in vocab if not (t.endswith(ending) and len(t) > len(ending))}
        self.final = {t[: -len(ending)] for t in vocab if t.endswith(ending) and len(t) > len(ending)}
        tokens = self.inner | self.final
        self.longest = max(map(len, tokens))
        self.beginnings = {t[:i] for t in tokens for i in range(1, len(t))}
        self.symbol = byte_symbols()
        self.apart = Remembered()
        self.forget()

    def forget(self) -> None:
        self.numbers, self.states, self.go, self.end = {}, [], [], []
        self.start = self.number("", ((START, 0),))

    def number(self, seen: str, entries: tuple) -> int:
        """Number of the state in which ``seen`` are the symbols that a longer token may
        still take up and ``entries`` the last tokens, with their counts, of the
        prefixes that end before, within and after them."""
        key = seen, entries
        if (n := self.numbers.get(key)) is None:
            n = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.go.append({})
            self.end.append({})
        return n

    def merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def stay_apart(self, left, token: str, ends: bool) -> bool:
        key = left, token, ends
        if (known := self.apart.get(key)) is not None:
            return known
        symbols = list(token)
        last = token + self.ending if ends else token
        if ends:
            symbols[-1] += self.ending
        want = [last] if left == START else [left, last]
        return self.apart.keep(key, self.merge([*("" if left == START else left), *symbols]) == want)

    def last_token(self, seen: str, entries: tuple, ends: bool) -> int:
        """Length of the last token of the prefix whose last symbols are ``seen``."""
        known = self.final if ends else self.inner
        for n in range(min(len(seen), len(entries), self.longest), 0, -1):
            token = seen[-n:]
            if token in known and self.stay_apart(entries[n - 1][0], token, ends):
                return n
        raise ValueError(f"no token for {seen!r}")

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """State after one more symbol, and the change of the token count."""
        seen, entries = self.states[state]
        seen += symbol
        n = self.last_token(seen, entries, False)
        delta = entries[n - 1][1] + 1
        token, keep = seen[-n:], len(seen)
        while keep and seen[-keep:] not in self.beginnings:
            keep -= 1
        moved = ((token, 0), *((t, c - delta) for t, c in entries[:keep]))
        found = self.go[state][symbol] = self.number(seen[len(seen) - keep :], moved), delta
        return found

    def finish(self, state: int, symbol: str) -> int:
        """Tokens emitted when ``symbol`` ends the word, beside those counted up to ``state``."""
        seen, entries = self.states[state]
        seen += symbol
        found = self.end[state][symbol] = entries[self.last_token(seen, entries, True) - 1][1] + 1
        return found

    def count(self, word: str) -> int:
        if len(self.states) > REMEMBERED:
            self.forget()
        symbols = [self.symbol[b] for b in word.encode()]
        state, total, go = self.start, 0, self.go
        last = symbols.pop()
        for s in symbols:
            state, delta = go[state].get(s) or self.step(state, s)
            total += delta
        return total + (self.end[state].get(last) or self.finish(state, last))


def kind_of(c: str) -> str:
    """Class of a character: L letter, N number, S white space, P other."""
    general = unicodedata.category(c)
    if general[0] in "LN":
        return general[0]
    return "S" if general[0] == "Z" or c in "\t\n\v\f\r\x85" else "P"


class TokenTransducer:
    """Counts the tokens of a stretch without ASCII white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = MergeTransducer(model["merges"], model["vocab"], model["end_of_word_suffix"])
        self.known, self.kinds, self.counted = Remembered(), Remembered(), PieceCounts(self.count)

    def word(self, w: str) -> int:
        n = self.known.get(w)
        if n is None:
            n = self.words.count(w)
            if len(w) <= 64:
                self.known.keep(w, n)
        return n

    def plain(self, text: str) -> int:
        """Tokens of a stretch without special strings: the boundary automaton.
        ``mode`` is the class of the word being read (' ' none, "'" after an
        apostrophe that began a word, or the first letter of a longer ending)."""
        total, mode, begun = 0, " ", 0
        text = unicodedata.normalize("NFC", text).lower()
        for i, c in enumerate(text):
            kind = self.kinds.get(c) or self.kinds.keep(c, kind_of(c))
            if mode == "'":
                if c in ENDINGS:
                    total, mode = total + self.word("'" + c), " "
                    continue
                mode = c if c in "rvl" else "P"
                if mode != "P":
                    continue
            elif mode in "rvl":
                if mode + c in ENDINGS:
                    total, mode = total + self.word("'" + mode + c), " "
                    continue
                total, mode, begun = total + self.word("'"), "L", i - 1
            if kind == mode != "N":
                continue
            if mode != " ":
                total += self.word(text[begun:i])
            mode, begun = ("'" if c == "'" else " " if kind == "S" else kind), i
        if mode in "rvl":
            return total + self.word("'") + self.word(mode)
        return total if mode == " " else total + self.word(text[begun:])

    def count(self, piece: bytes) -> int:
        # letters are a word of their own before any sign but the apostrophe
        core = piece.rstrip(SIGNS)
        if core.isalpha():
            signs = piece[len(core) :].decode()
            return self.word(core.lower().decode()) + (self.word(signs) if signs else 0)
        rest, n = piece.decode("utf-8", "replace"), 0
        while rest:
            found = min(((rest.index(s), s) for s in self.special if s in rest), default=None)
            if found is None:
                n += self.plain(rest)
                break
            n, rest = n + self.plain(rest[: found[0]]) + 1, rest[found[0] + len(found[1]) :]
        return n

    def state_map(self, chunk: bytes) -> tuple[bytes, int, bytes | None]:
        """(head, tokens after it, tail) of a chunk; no tail when it has no white space."""
        pieces = chunk.split(None, 1)
        head = pieces[0] if pieces and chunk[:1].strip() else b""
        if len(head) == len(chunk):
            return head, 0, None
        chunk = chunk[len(head) :]
        pieces = chunk.rsplit(None, 1)
        tail = pieces[-1] if pieces and chunk[-1:].strip() else b""
        inner = chunk[: len(chunk) - len(tail)]
        if b"<|" not in inner:  # a special string counts only as it is written
            inner = inner.lower()
        return head, sum(map(self.counted.__getitem__, inner.split())), tail


class PieceCounts(dict):
    """piece -> tokens; remembers ``REMEMBERED`` short pieces."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, piece: bytes) -> int:
        n = self.count(piece)
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of ``docs``.

    Repeated rows and null ids are rows of their own; a null or empty text has
    no bytes and no tokens; texts of any length are read whole, in chunks; other
    columns are not read; an empty table gives no rows.
    """
    import pyarrow as pa

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                       F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def maps(batches):
        transducer = remembered(("transducer", tokenizer_path), lambda: TokenTransducer(tokenizer_path))
        kinds = [pa.int64(), None, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names = ["row", "doc_id", "chunk", "n_bytes", "n_tokens", "head", "tail"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                out = []
                for row, doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns), strict=True):
                    for i, begin in enumerate(range(0, max(len(text), 1), chunk_bytes)):
                        chunk = text[begin : begin + chunk_bytes]
                        head, n, tail = transducer.state_map(chunk)
                        out.append((row, doc, i, len(chunk), n, head, tail))
                columns = zip(zip(*out, strict=True), kinds, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t or batch.schema.field("doc_id").type) for c, t in columns], names=names)

    def joints(batches):
        transducer = remembered(("transducer", tokenizer_path), lambda: TokenTransducer(tokenizer_path))
        for batch in batches:
            counts = [transducer.count(x) for x in batch.column("joint").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(3)] + [pa.array([a + n for a, n in zip(batch.column("n_tokens").to_pylist(), counts, strict=True)], pa.int64())],
                names=["row", "doc_id", "n_bytes", "n_tokens"])

    chunks = rows.mapInArrow(maps, f"row long, doc_id {id_type}, chunk long, n_bytes long, n_tokens long, head binary, tail binary")
    # the scan: white space seen before a chunk numbers the stretch that its head belongs to
    order = Window.partitionBy("row").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    entered = chunks.withColumn("stretch", F.coalesce(F.count("tail").over(order), F.lit(0)))
    parts = entered.select("row", "doc_id", "chunk", F.inline(F.array(
        F.struct("stretch", "n_bytes", "n_tokens", F.col("head").alias("part")),
        F.struct(F.expr("stretch + 1").alias("stretch"), F.lit(0).cast("long").alias("n_bytes"),
                 F.lit(0).cast("long").alias("n_tokens"), F.col("tail").alias("part")))))
    ordered = F.array_sort(F.collect_list(F.when(F.length("part") > 0, F.struct("chunk", "part"))))
    stretches = parts.groupBy("row", "stretch").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), ordered.alias("parts"))
    stretches = stretches.select(
        "row", "doc_id", "n_bytes", "n_tokens",
        F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["part"])).alias("joint"))
    counted = stretches.mapInArrow(joints, f"row long, doc_id {id_type}, n_bytes long, n_tokens long")
    return counted.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens")).drop("row")
