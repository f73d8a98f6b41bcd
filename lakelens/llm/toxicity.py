"""Toxicity by cumulative-link ordinal regression on sparse words (operator 8).

Grades are ordered: 0 clean, 1 mild, 2 severe (any number of grades can be
given).  One weight vector serves all thresholds: P(grade >= k) =
logistic(score - threshold_k), with score = sum of weight x (1 + ln count)
over the words of a text, and rising thresholds.  The expected severity is the
sum of P(grade >= k) over k >= 1; a text is toxic from the score that divides the
sample's graded texts from its others with the fewest errors.

The model is fitted on a bounded sample of labelled rows (``MAX_LABELLED``,
those with the smallest hash of their id); scoring reads all rows and whole
texts.  Features are hashed: words without signs, and their runs of ``GRAM``
characters, edges included, so that inflected forms share what they have in
common.  Spark counts the features over the sample; the fit keeps those (at most
``MAX_FEATURES``) that stand in graded texts ``Z`` standard errors more often
than by chance and mostly there, so that chance words and single wrong labels
carry no weight.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.llm.words import kept_table, mixed, remembered

BITS, GRAM = 40, 5
MAX_LABELLED, MAX_FEATURES = 10_000, 4_000
Z, LEAST_TEXTS, MOSTLY, RIDGE, STEPS = 4.0, 5, 0.8, 0.05, 500

#: Signs that are cut off both ends of a word.
EDGES = ".,;:!?\"'()[]{}<>*_-#&%|/\\"


class WordFeatures(dict):
    """raw word -> slots of its features (none if only signs are left)."""

    def __missing__(self, raw: str) -> tuple[int, ...]:
        import xxhash

        word = raw.lower().strip(EDGES)
        marked = f"^{word}$"
        parts = {marked, *(marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1))} if word else ()
        slots = tuple(sorted(xxhash.xxh3_64_intdigest(p.encode("utf-8", "replace")) >> (64 - BITS) for p in parts))
        if len(self) < 1 << 17:
            self[raw] = slots
        return slots


def counted(text: str | None, features: WordFeatures) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text's features, and how many words have each."""
    words = (text or "").split()
    found = np.fromiter((s for w in words for s in features[w]), np.int64)
    return np.unique(found, return_counts=True)


class Marked(dict):
    """raw word -> number of its set of weighted features (0 none); ``sets`` has their places."""

    def __init__(self, slots: np.ndarray):
        super().__init__()
        self.features, self.sets = WordFeatures(), [()]
        self.place = {s: i for i, s in enumerate(slots.tolist())}

    def __missing__(self, raw: str) -> int:
        places = tuple(self.place[s] for s in self.features[raw] if s in self.place)
        n = 0
        if places:
            self.sets.append(places)
            n = len(self.sets) - 1
        if len(self) < 1 << 18 or places:
            self[raw] = n
        return n


@dataclass
class OrdinalModel:
    slots: np.ndarray  # of the words with a weight, sorted
    weights: np.ndarray
    thresholds: np.ndarray  # rising, one for each grade above 0
    cut: float  # score from which a text is toxic

    def score(self, text: Column) -> Column:
        """The texts' scores; a null text has no words and scores 0."""
        slots, weights = self.slots, self.weights

        @F.pandas_udf("double")
        def scores(batches: pd.Series) -> pd.Series:
            marked, out = remembered(("marked", slots.tobytes()), lambda: Marked(slots)), np.zeros(len(batches))
            for i, text in enumerate(batches):
                words = (text or "").split()
                found = np.fromiter(map(marked.__getitem__, words), np.int64, len(words))
                found = found[found > 0].tolist()
                if found:
                    at, n = np.unique([p for f in found for p in marked.sets[f]], return_counts=True)
                    out[i] = float(np.sum(weights[at].astype(np.float64) * (1 + np.log(n))))
            return pd.Series(out)

        return scores(text)

    def graded(self, docs: DataFrame, *, text_col: str = "text") -> DataFrame:
        """``docs`` and p_toxic, expected_severity, grade (the likeliest) and toxic,
        which take the place of columns of these names.  Every row stays, repeated rows
        and null ids or texts included; equal texts get equal grades, very long ones are
        read whole; an empty table stays empty."""
        score = "__score"
        while score in docs.columns:
            score += "_"
        reach = [1 / (1 + F.exp(F.lit(float(t)) - F.col(score))) for t in self.thresholds]
        likely = [a - b for a, b in zip([F.lit(1.0), *reach], [*reach, F.lit(0.0)], strict=True)]
        best = F.array_position(F.array(*likely), F.array_max(F.array(*likely))).cast("int") - 1
        total = reach[0]
        for r in reach[1:]:
            total = total + r
        scored = docs.withColumn(score, self.score(F.col(text_col)))
        return scored.withColumns({"p_toxic": reach[0], "expected_severity": total, "grade": best,
                                   "toxic": F.col(score) >= self.cut}).drop(score)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def telling(n_bad: np.ndarray, n_all: np.ndarray, bad: int, total: int) -> np.ndarray:
    """Standard errors by which each feature's graded texts exceed chance; 0 for
    features that are rare or not mostly in graded texts."""
    p = min(max(bad / max(1, total), 1e-9), 1 - 1e-9)
    z = (n_bad - n_all * p) / np.sqrt(n_all * p * (1 - p))
    return np.where((z >= Z) & (n_all >= LEAST_TEXTS) & (n_bad >= MOSTLY * n_all), z, 0.0)


def fit_ordinal(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> OrdinalModel:
    """Fits (grade, slots, counts) rows by gradient steps (Adam) on the
    cumulative-link likelihood."""
    grades = np.array([g for g, _, _ in rows], np.int64)
    top = max(1, int(grades.max(initial=0)))
    share = np.array([(np.sum(grades >= k) + 0.5) / (len(grades) + 1) for k in range(1, top + 1)])
    thresholds = np.log((1 - share) / share)
    if not rows:
        return OrdinalModel(np.empty(0, np.int64), np.empty(0, np.float32), thresholds, np.inf)
    at = np.concatenate([s for _, s, _ in rows])
    doc = np.repeat(np.arange(len(rows)), [len(s) for _, s, _ in rows])
    values = 1 + np.log(np.concatenate([c for _, _, c in rows]))
    slots, column = np.unique(at, return_inverse=True)
    # gaps between thresholds are kept positive by fitting their logarithms
    w = np.zeros(len(slots))
    free = np.concatenate([thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-3))])
    moments = [np.zeros(len(w) + top), np.zeros(len(w) + top)]
    for step in range(1, STEPS + 1):
        thresholds = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        score = np.bincount(doc, w[column] * values, len(rows))
        edges = np.concatenate([[-40.0], thresholds, [40.0]])
        below, above = logistic(edges[grades + 1] - score), logistic(edges[grades] - score)
        likely = np.maximum(below - above, 1e-12)
        d_below, d_above = below * (1 - below) / likely, above * (1 - above) / likely
        d_score = -(d_below - d_above)
        d_edge = np.bincount(grades + 1, d_below, top + 2) - np.bincount(grades, d_above, top + 2)
        d_edge = d_edge[1:-1]
        d_free = np.concatenate([[d_edge.sum()], np.exp(free[1:]) * np.cumsum(d_edge[::-1])[::-1][1:]])
        d_w = np.bincount(column, d_score[doc] * values, len(w)) - RIDGE * w
        slope = np.concatenate([d_w, d_free])
        for m, value, rate in ((moments[0], slope, 0.9), (moments[1], slope**2, 0.999)):
            m *= rate
            m += (1 - rate) * value
        move = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w, free = np.maximum(w + move[: len(w)], 0), free + move[len(w) :]  # telling words only raise a score
    thresholds = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
    w = w.astype(np.float32)
    score = np.bincount(doc, w.astype(np.float64)[column] * values, len(rows))
    return OrdinalModel(slots, w, thresholds, best_cut(score, grades > 0))


def best_cut(score: np.ndarray, graded: np.ndarray) -> float:
    """Middle of the gap between scores that leaves the fewest rows on the wrong side;
    the highest such gap, and no row above it without graded rows."""
    levels, at = np.unique(score, return_inverse=True)
    good = np.bincount(at, ~graded, len(levels))
    bad = np.bincount(at, graded, len(levels))
    wrong = np.append(0, np.cumsum(bad)) + np.append(np.cumsum(good[::-1])[::-1], 0)
    i = len(wrong) - 1 - int(np.argmin(wrong[::-1]))
    if i == len(levels):
        return np.inf
    return float(levels[0]) - 1 if i == 0 else float(levels[i - 1] + levels[i]) / 2


def least_words(text: str | None) -> list[int]:
    """The 16 least hashes of a text's words."""
    import xxhash

    found = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in {*(text or "").split()}], np.uint64)
    return np.sort(mixed(found))[:16].view(np.int64).tolist()


def one_of_copies(sketches: list[list[int]]) -> list[int]:
    """Places of the sketches that share less than half with each earlier one kept:
    near copies of one text would make its words look like marks of its grade."""
    holders, kept = defaultdict(list), []
    for n, least in enumerate(sketches):
        shared = Counter(i for h in least for i in holders[h])
        if least and max(shared.values(), default=0) * 2 >= len(least):
            continue
        for h in least:
            holders[h].append(n)
        kept.append(n)
    return kept


def graded_by_amount(grades: list[int], counts: list[np.ndarray]) -> list[int]:
    """Grades for rows labelled 0 or 1 only: a text labelled 1 is severe (2) when it
    has at least the median amount (sum of 1 + ln count) of telling features among
    such texts, else mild (1)."""
    amount = [float(np.sum(1 + np.log(c))) for c in counts]
    marked = [x for g, x in zip(grades, amount, strict=True) if g and x]
    middle = float(np.median(marked)) if marked else np.inf
    return [2 if g and x >= middle else g for g, x in zip(grades, amount, strict=True)]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        grade_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> OrdinalModel:
    """Model from at most ``max_labelled`` labelled rows.

    Labels without a grade or id, or without a document, are left out; a null text
    has no words; of several labels of one id the highest counts.  Labels that only
    know 0 and 1 are graded by ``graded_by_amount``; without labels no text is toxic.
    """
    labelled = (labels.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull())
                .groupBy(F.col(id_col).alias("id")).agg(F.max(grade_col).cast("int").alias("grade"))
                .orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most max_labelled small rows are broadcast
    rows = kept_table(texts.join(F.broadcast(labelled), "id").withColumn("id", F.col("id").cast("string")), "labelled")

    def sketched(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "grade": batch["grade"], "least": [least_words(t) for t in batch["text"]]})

    found = rows.mapInPandas(sketched, "id string, grade int, least array<long>").toArrow().to_pylist()
    found.sort(key=lambda r: (r["id"], r["grade"], r["least"]))
    kept = [found[i] for i in one_of_copies([r["least"] for r in found])]
    use, bad = {r["id"] for r in kept}, sum(r["grade"] > 0 for r in kept)

    def features(batches):
        known = WordFeatures()
        for batch in batches:
            batch = batch[batch["id"].isin(use)]
            parts = [counted(t, known)[0] for t in batch["text"]]
            slots = np.concatenate([*parts, np.empty(0, np.int64)])
            graded = np.repeat((batch["grade"] > 0).to_numpy(), [len(p) for p in parts])
            yield pd.DataFrame({"slot": slots, "bad": graded.astype(np.int64)})

    counts = (rows.mapInPandas(features, "slot long, bad long").groupBy("slot")
              .agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
              .where((F.col("n") >= LEAST_TEXTS) & (F.col("bad") >= MOSTLY * F.col("n")))
              .orderBy(F.desc("bad"), F.col("n"), "slot").limit(MAX_FEATURES)).toArrow().to_pydict()
    z = telling(np.array(counts["bad"], float), np.array(counts["n"], float), bad, len(kept))
    slots = np.sort(np.array(counts["slot"], np.int64)[z > 0])

    def telling_counts(batches):
        known = WordFeatures()
        for batch in batches:
            batch = batch[batch["id"].isin(use)]
            every = [counted(t, known) for t in batch["text"]]
            mine = [np.isin(s, slots) for s, _ in every]
            yield pd.DataFrame({"id": batch["id"], "grade": batch["grade"], "slots": [s[m] for (s, _), m in zip(every, mine, strict=True)],
                                "counts": [c[m] for (_, c), m in zip(every, mine, strict=True)]})

    given = rows.mapInPandas(telling_counts, "id string, grade int, slots array<long>, counts array<long>").toArrow().to_pylist()
    given.sort(key=lambda r: (r["id"], r["grade"], r["slots"]))
    grades, occur = [r["grade"] for r in given], [np.array(r["counts"], np.int64) for r in given]
    if max(grades, default=0) < 2:
        grades = graded_by_amount(grades, occur)
    return fit_ordinal([(g, np.array(r["slots"], np.int64), c) for g, r, c in zip(grades, given, occur, strict=True)])


def severities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_toxic, expected_severity, grade and toxic of every document."""
    return fit(docs, labels).graded(docs.select("doc_id", "text")).drop("text")


def without_toxic(docs: DataFrame, labels: DataFrame, labelled_docs: DataFrame | None = None) -> DataFrame:
    """The rows that the model doesn't call toxic, with the columns of ``docs``.  The model is
    fitted on ``labelled_docs`` (``docs`` if not given)."""
    model = fit(docs if labelled_docs is None else labelled_docs, labels)
    graded = model.graded(docs.select(F.struct("*").alias("whole"), F.col("text").alias("text")))
    return graded.where(~F.col("toxic")).select("whole.*")
