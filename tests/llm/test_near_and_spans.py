"""Operators 4, 5, 7 and 8 against brute force and held-out labels."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from lakelens.llm import decontaminate, ngram_join, sentence_spans, toxicity
from tests.conftest import SF001, SF01


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_components(rows, k, percent):
    by = defaultdict(list)
    for doc, text in rows:
        by[shingle_set(text, k)].append(doc)
    sets = [s for s in by if s]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        for j, shared in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, s in enumerate(sets):
        least[root(i)] += [d for d in by[s] if d is not None]
    out = [(d, 0, d) for d in by.get(frozenset(), [])]
    return Counter(out + [(d, len(s), min(least[root(i)], default=None)) for i, s in enumerate(sets) for d in by[s]])


def near_family(seed=3):
    """Groups of copies with a few words changed, sharing lines, in sizes that make long lists."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    line = [word() for _ in range(8)]
    out = []
    for group in range(4):
        base = [word() for _ in range(60 + 30 * group)] + line * (group % 2)
        for _ in range((150, 60, 20, 5)[group]):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = word() + "x"
            out.append(" ".join(copy))
    return list(enumerate(out))


@pytest.mark.parametrize(("k", "percent", "short"), [(3, 90, 32), (3, 90, 4), (5, 80, 6)])
def test_near_groups_equal_brute_force(spark, odd, sf001, k, percent, short):
    family = spark.createDataFrame(near_family(), "doc_id long, text string")
    for docs in (odd, family, sf001):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = ngram_join.near_groups(docs, k=k, percent=percent, short=short, bits=20).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, k, percent)


def test_one_large_family_without_squares(spark, monkeypatch):
    """600 near copies, far ones among them, in two versions: every link, and pairs in proportion to the members."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    other = base[:25] + [f"v{i}" for i in range(14)] + base[39:]
    rows = []
    for i in range(600):
        copy = list(other if i % 3 == 0 else base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            copy[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, whole = [], ngram_join.pairs_of

    def pairs_of(*a):
        out = whole(*a)
        made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "pairs_of", pairs_of)
    k, percent = 5, 80
    got = ngram_join.near_groups(docs, k=k, percent=percent, bits=20).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, k, percent)
    assert sum(made) < 60 * len(rows) and len(made) < 9, made


def test_near_groups_of_nothing(empty):
    assert ngram_join.near_groups(empty, bits=16).count() == 0


def test_one_row_of_each_near_group_stays(spark):
    family = near_family()
    docs = spark.createDataFrame([(i, t, "x") for i, t in family], "doc_id long, text string, gone string")
    kept = ngram_join.without_near_copies(docs, 3, 90)
    assert kept.columns == docs.columns
    groups = brute_components(family, 3, 90)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in groups})


def brute_runs(pieces, reach, run):
    """Runs of so many words that begin at the word with the smallest hash (upper half) of ``reach`` words."""
    if not reach:
        return []
    hashes = [(sentence_spans.described(p)[0] >> 32, i) for i, p in enumerate(pieces)]
    starts = {min(hashes[i : i + reach])[1] for i in range(len(pieces) - reach + 1)}
    return [(a, a + run) for a in sorted(starts) if a + run <= len(pieces)]


def brute_spans(rows, sentences=2, least=12, reach=0, run=36):
    """Removed word places of each row, by the definition."""
    cut = {}
    for key, (doc, text) in enumerate(rows):
        pieces = sentence_spans.WORD.findall(text or "")
        begins = [i for i, p in enumerate(pieces) if i == 0 or p.strip()[:1].isupper() or not pieces[i - 1].strip()
                  or "\n" in pieces[i - 1] or pieces[i - 1].strip().rstrip("\"')]»”’")[-1:] in (".", "!", "?")]
        edges = [*begins, len(pieces)] if pieces else []
        spans = []
        for i in range(len(edges) - 1):
            to = next((j for j in range(i + sentences, len(edges)) if edges[j] - edges[i] >= least), None)
            if to is not None:
                words = tuple(p.strip().encode().lower() for p in pieces[edges[i] : edges[to]])
                spans.append((words, edges[i], edges[to]))
        known = {(x, y) for _, x, y in spans}
        for a, b in brute_runs(pieces, reach, run):
            if (a, b) not in known:
                spans.append((tuple(p.strip().encode().lower() for p in pieces[a:b]), a, b))
        spans.sort(key=lambda s: s[1])
        cut[key] = (doc, pieces, spans)
    first = {}
    big = 1 << 63
    for doc, _, spans in cut.values():
        for words, _, _ in spans:
            first[words] = min(first.get(words, big), big - 1 if doc is None else doc)
    out = Counter()
    for doc, pieces, spans in cut.values():
        met, gone = set(), set()
        for words, a, b in spans:
            if (big - 1 if doc is None else doc) > first[words] or words in met:
                gone.update(range(a, b))
            met.add(words)
        kept = "".join(p for i, p in enumerate(pieces) if i not in gone)
        size = len("".join(pieces).encode())
        out[doc, size, size - len(kept.encode()), sum(i - 1 not in gone for i in gone), kept] += 1
    return out


def test_sentence_spans_equal_brute_force(spark, odd, sf001, empty):
    passage = "Here is one passage of words. It goes on for a while. It has three sentences and ends now."
    planted = spark.createDataFrame(
        [(1, "Start here. " + passage + " Other end."), (2, "we go on " + passage + " and on."), (3, passage),
         (3, "Same id again. " + passage), (4, passage + " " + passage), (5, "Nothing to see. Clean text stays whole as it is, always.")],
        "doc_id long, text string")
    for docs in (odd, planted, sf001):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = Counter(tuple(r) for r in sentence_spans.dedup_sentences(docs, bits=18).collect())
        assert got == brute_spans(rows)
        if docs is odd:  # one text of 27,000 words
            continue
        got = Counter(tuple(r) for r in sentence_spans.dedup_sentences(docs, bits=18, reach=sentence_spans.REACH).collect())
        assert got == brute_spans(rows, reach=sentence_spans.REACH, run=sentence_spans.RUN)
        if docs is planted:
            got = Counter(tuple(r) for r in sentence_spans.dedup_sentences(docs, bits=18, reach=3, run=9).collect())
            assert got == brute_spans(rows, reach=3, run=9)
    got = {r.doc_id: r for r in sentence_spans.dedup_sentences(planted, bits=18).where("doc_id <> 3").collect()}
    assert got[1].n_removed == got[5].n_removed == 0 and got[2].kept_text.strip() == "we go on and on." and got[4].kept_text == ""
    assert sentence_spans.dedup_sentences(empty, bits=16).count() == 0


def test_templates_catch_new_numbers_and_names(spark, odd, empty):
    items = spark.createDataFrame([
        (1, "A train leaves Boston at 9 and meets Anna after 40 km because the line from Boston is slow today.", "h"),
        (2, "The quick brown fox jumps over the lazy dog while nobody in the village is looking.", "h"),
        (3, "lone words", "h"), (4, None, "h"), (5, "1 2 3 4 5 6 7", "h"), (2, "The quick brown fox jumps over the lazy dog while nobody in the village is looking.", "h")],
        "item_id long, text string, h string")
    docs = spark.createDataFrame([
        (10, "Well: a train leaves Denver at 7 and meets Paula after 15 miles because the line from Denver is slow today. So.", 0),
        (11, "Then a train leaves Denver at 7 and meets Paula after 15 miles because the line from Chicago is slow today.", 0),
        (12, "so the quick brown fox jumps over the lazy dog while nobody in the village is looking at it", 0),
        (13, "The quick brown fox is here, and the lazy dog too, while 5 6 7 8 9 stay away from the village.", 0),
        (14, "lone words", 0), (15, None, 0), (None, "The quick brown fox jumps over the lazy dog while nobody in the village is looking.", 0)],
        "doc_id long, text string, h int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, items, consistency=0.9).collect()}
    assert set(got) == {(10, 1), (12, 2), (14, 3), (None, 2)}
    assert not got[10, 1].exact and got[None, 2].exact
    assert (11, 1) in {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, consistency=0.5).collect()}
    clean = decontaminate.decontaminated(docs, items)
    assert clean.columns == docs.columns and {13, 15} <= {r.doc_id for r in clean.collect()} <= {11, 13, 15}
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.contaminated(odd, items).count() == 0


def test_leaks_equal_a_plain_search(spark):
    docs, items = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "benchmark"))
    want = set()
    words = {r.item_id: r.text.lower().split() for r in items.collect()}
    for r in docs.collect():
        flat = " " + " ".join(r.text.lower().split()) + " "
        want |= {(r.doc_id, i) for i, w in words.items() if " " + " ".join(w) + " " in flat}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert want <= got and len(got) <= 1.1 * len(want) + 2


def test_toxicity_on_held_out_labels(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"{SF01.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 4 <> 0"))
    assert all(a < b for a, b in zip(model.thresholds, model.thresholds[1:], strict=False)) and len(model.thresholds) == 2
    held = model.graded(docs.join(labels.where("doc_id % 4 = 0"), "doc_id").select("doc_id", "text", labels["toxic"].alias("is_toxic"))).toPandas()
    caught = held["toxic"] & (held["is_toxic"] == 1)
    assert (held["toxic"] & (held["is_toxic"] == 0)).sum() <= 0.01 * len(held)
    assert caught.sum() >= 0.85 * held["is_toxic"].sum()
    assert held.loc[held["toxic"], "expected_severity"].min() >= held.loc[~held["toxic"], "expected_severity"].max()
    scored = model.graded(odd)
    assert scored.count() == odd.count() and not any(r.toxic for r in scored.collect())
    assert model.graded(empty).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert not any(r.toxic for r in none.graded(odd).collect())
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 0 < docs.count() - kept.count() < 0.1 * docs.count()


def test_ordinal_model_learns_ordered_grades():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for _ in range(600):
        grade = int(rng.integers(0, 4))
        slots = np.unique(rng.integers(100, 2000, 20))
        rows.append((grade, np.append(np.array([7]), slots) if grade else slots, np.append(np.array([3**grade]), np.ones(len(slots), int)) if grade else np.ones(len(slots), int)))
    model = toxicity.fit_ordinal(rows)
    assert 7 in model.slots and len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    weight = float(model.weights[list(model.slots).index(7)])
    likely = [np.sum(weight * (1 + np.log(3**g)) > model.thresholds) if g else 0 for g in range(4)]
    assert likely == [0, 1, 2, 3]


def test_repeated_passages_without_whole_sentences_are_removed(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    words = lambda n: " ".join(word() for _ in range(n))
    rows, shared = [], []
    for n in range(40):
        passage = words(51) if n % 2 else f"{words(25)}. {words(26)}"  # no sentence inside, or an end and a beginning
        shared.append(passage.split())
        rows += [(2 * n, f"{words(rng.randrange(30))} {passage} {words(rng.randrange(30))}"),
                 (2 * n + 1, f"{words(rng.randrange(30))} {passage} {words(rng.randrange(30))}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sentence_spans.dedup_sentences(docs, reach=sentence_spans.REACH).collect()}
    assert {r.doc_id: r.n_removed for r in sentence_spans.spans_digest(docs).collect()} == {d: r.n_removed for d, r in got.items()}
    for n, passage in enumerate(shared):
        assert got[2 * n].n_removed == 0
        later = got[2 * n + 1]
        assert later.n_removed > 0 and " ".join(passage) not in " ".join(later.kept_text.split())
        gone = set(dict(rows)[2 * n + 1].split()) - set(later.kept_text.split())
        assert gone <= set(passage) and len(gone) >= sentence_spans.RUN


def test_a_stretch_within_a_long_sentence_stays(spark):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    shared = words(31)
    docs = spark.createDataFrame([(i, f"{words(40)} {shared} {words(40)}") for i in range(3)], "doc_id long, text string")
    assert {r.n_removed for r in sentence_spans.spans_digest(docs).collect()} == {0}


def test_other_scripts_have_sentences(spark):
    rng = random.Random(12)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))
    hindi = lambda n: " ".join("".join(chr(rng.randrange(0x0915, 0x0939)) for _ in range(4)) for _ in range(n))
    a, b = f"{han(30)}。{han(25)}！{han(20)}。", f"{hindi(9)}। {hindi(8)}। {hindi(9)}।"
    docs = [(1, han(9) + "。" + a + han(7)), (2, han(12) + "。" + a + han(5)), (3, hindi(5) + "। " + b), (4, hindi(6) + "। " + b)]
    got = {r.doc_id: r for r in sentence_spans.dedup_sentences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].n_removed == got[3].n_removed == 0
    assert a not in got[2].kept_text and got[2].n_removed > len(a.encode()) // 2
    assert got[4].n_removed >= len(b.encode()) - 1


def test_a_leak_stays_one_beside_other_occurrences(spark):
    ask = "So a farmer sells {} baskets of ripe apples and then buys {} boxes of fresh pears at the market."
    tables = "add {} to the running sum now, add {} to the running sum now, add {} to the running sum now."
    items = spark.createDataFrame([(1, ask.format(5, 3)), (2, tables.format(4, 9, 6))], "item_id long, text string")
    other = ask.replace("and then", "and only then")
    docs = spark.createDataFrame([
        (1, ask.format(5, 3) + " " + ask.format(7, 4)), (2, tables.format(4, 9, 6)),
        (3, other.format(5, 3) + " " + other.format(3, 5) + " " + other.format(5, 8)),
        (4, "a farmer sells 5 baskets of ripe plums")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1): True, (2, 2): True, (3, 1): False}
    assert [r.doc_id for r in decontaminate.decontaminated(docs, items).collect()] == [4]


def brute_leaks(docs, items, coverage=0.5, consistency=0.8):
    """Every document against every item: the leaked pairs, and those that are exact."""
    memo, pairs, exact = decontaminate.word_table(), set(), set()
    windows = lambda t: [w[1:] for w in decontaminate.windows([t], memo, decontaminate.WINDOW)]
    read = [(d, windows(t)) for d, t in docs]
    for i, t in items:
        asked = windows(t)
        hashes = {h for _, h, _ in asked}
        for d, told in read:
            groups = defaultdict(list)
            for p, h, ours in told:
                for q, g, theirs in asked if h in hashes else ():
                    if g == h:
                        for key in ((0, 0), (1, p - q), (2, (p - q) // 16), (3, (p - q + 8) // 16)):
                            groups[key].append((q, h, theirs, ours))
            for (kind, _), rows in groups.items():
                bound = {b for _, _, theirs, ours in rows for b in zip(theirs, ours, strict=True)}
                share = min(len({a for a, _ in bound}), len({b for _, b in bound})) / len(bound) if bound else 1.0
                if len({h for _, h, _, _ in rows}) >= coverage * len(hashes) and share >= consistency:
                    pairs.add((d, i))
                    if kind == 1 and len(rows) == len(asked) and all(theirs == ours for _, _, theirs, ours in rows):
                        exact.add((d, i))
    return pairs, exact


def test_leaks_equal_brute_force(spark):
    rng = random.Random(21)
    plain = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me", "so") for b in ("la", "nk", "rt", "ss", "tten")]
    value = lambda: rng.choice([str(rng.randrange(6)), rng.choice(["Anna", "Boston", "Carl"]), "km", "hours"])
    frames = [[rng.choice([*plain, *plain, *plain, None]) for _ in range(rng.randrange(8, 30))] for _ in range(8)]
    frames[1] = frames[0][:12] + frames[1]
    said = lambda f: [w or value() for w in f]
    items = [(i, " ".join(said(frames[i % 8]))) for i in range(60)]
    docs = []
    for d in range(120):
        words = [rng.choice(plain) for _ in range(rng.randrange(12))]
        for _ in range(rng.randrange(3)):
            held = rng.choice(items)[1].split() if rng.random() < 0.5 else said(rng.choice(frames))
            if rng.random() < 0.3:
                held.insert(rng.randrange(len(held)), rng.choice(plain))
            words += held[rng.choice([0, 0, 3]) :] + [rng.choice(plain) for _ in range(rng.randrange(6))]
        docs.append((d, " ".join(words)))
    texts, asked = (spark.createDataFrame(r, f"{c} long, text string") for r, c in ((docs, "doc_id"), (items, "item_id")))
    pairs, exact = brute_leaks(docs, items)
    rows = decontaminate.contaminated(texts, asked).collect()
    members = defaultdict(set)
    for r in decontaminate.item_classes(asked).collect():
        members[r.item_class].add(r.item_id)
    assert {(r.doc_id, i) for r in rows for i in members[r.item_class]} == pairs and len(pairs) > 200
    assert {(r.doc_id, r.item_id) for r in rows if r.exact} <= exact and {d for d, _ in exact} == {r.doc_id for r in rows if r.exact}
    assert all(r.class_items == len(members[r.item_class]) and r.item_id in members[r.item_class] for r in rows)
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows) < len(pairs)


def test_one_question_in_many_versions_is_one_class(spark):
    ask = "a farmer sells {} baskets of ripe apples and walks home along the river before the sun goes down"
    items = spark.createDataFrame([(i, ask.format(i)) for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(d, f"we say {ask.format(200 + d)} again") for d in range(200)], "doc_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.exact, r.class_items) for r in got) == [
        (d, 200 + d if d < 100 else 0, d < 100, 300) for d in range(200)]


def test_short_and_placeholder_items_are_found_word_by_word(spark):
    items = spark.createDataFrame([(1, "purple Cows sing softly"), (2, "12 13 17 19 23 29 31"), (3, "so it is"), (4, "3 4 5 6")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, "they say: Purple cows sing softly, at night in the meadow"), (2, "primes 12 13 17 19 23 29 31 end here"),
                                  (3, "and so it is with all of us here today"), (4, "so it is"), (5, "14 15 18 20 24 30 32 and more of it"),
                                  (6, "3 4 5 6"), (7, "7 3 4 5 6 7 for all of us")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1): True, (2, 2): True, (4, 3): True, (6, 4): True, (7, 4): True}


def copies_of_one(n, words=400):
    """Texts that differ from one text in a word of their own each."""
    base = [f"w{i}" for i in range(words)]
    return [(i, " ".join([*base[:7 * i % words], f"own{i}", *base[7 * i % words + 1:]])) for i in range(n)]


def test_members_that_are_all_near_have_no_postings(spark, monkeypatch):
    """Near members only meet far ones; without far ones they take no part in another level."""
    from lakelens.llm import ngram_join

    levels, level = [], ngram_join.next_level

    def counted(*args, **named):
        out = level(*args, **named)
        levels.append(out[1].count())
        return out

    monkeypatch.setattr(ngram_join, "next_level", counted)
    rows = copies_of_one(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_groups(df)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, 0) for i, _ in rows}
    assert levels == [0]


def test_lists_with_the_same_voters_read_their_sets_once(spark, monkeypatch):
    """Sixty copies share many n-grams of their prefixes: many lists with the same members, and one vote."""
    from lakelens.llm import ngram_join

    made, kept = {}, ngram_join.kept_table

    def counting(df, name):
        table = kept(df, name)
        made.setdefault(name, table.count())
        return table

    monkeypatch.setattr(ngram_join, "kept_table", counting)
    rows = [(i, t + f" end{i}") for i, t in enumerate([" ".join(f"w{j}" for j in range(100))] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in ngram_join.near_groups(df).collect()} == {0}
    assert made["centred-lists"] > 5 and made["centres"] == 1


def test_texts_go_to_workers_in_small_batches(spark, monkeypatch):
    """Tables made from whole texts get at most 1,000 texts at once, also in the pipeline's stage."""
    from lakelens.llm import ngram_join

    most, kept = {}, ngram_join.kept_table

    def noting(df, name):
        most[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return kept(df, name)

    monkeypatch.setattr(ngram_join, "kept_table", noting)
    df = spark.createDataFrame(copies_of_one(3), "doc_id long, text string")
    assert ngram_join.without_near_copies(df, k=5, percent=80).count() == 1
    assert max(most[name] for name in ("sets", "prefixes", "set-members")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000


def test_lists_without_pairs_go_and_few_far_members_make_no_long_list(spark):
    """Far members that only look for near ones have no pairs among themselves, nor have near ones."""
    rows = [(1, s) for s in [2] * 50] + [(2, s) for s in [1] * 50] + [(3, s) for s in [1] * 50 + [2] * 3]
    rows += [(4, s) for s in [1] * 50 + [2] * 50] + [(5, 0)] + [(6, s) for s in [0] * 40] + [(7, s) for s in [0] * 5]
    lists = ngram_join.list_sizes(spark.createDataFrame(rows, "key long, side int"), 32).collect()
    assert {(r.key, r.size, r.long) for r in lists} == {(3, 53, False), (4, 100, True), (6, 40, True), (7, 5, False)}


def test_far_members_of_one_family_have_few_postings(spark, monkeypatch):
    """Near copies with words from a short list, many of them far from the centre: what a centre's members have is
    counted for that centre, so that its rare n-grams come first on every level."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 6])):
            copy[rng.randrange(150)] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    levels, level = [], ngram_join.next_level

    def counted(*args, **named):
        out = level(*args, **named)
        levels.append(out[1].count())
        return out

    monkeypatch.setattr(ngram_join, "next_level", counted)
    got = ngram_join.near_groups(docs, k=5, percent=80, bits=20).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 5, 80)
    assert sum(levels) < 40 * len(rows), levels


def test_only_ngrams_that_different_sets_have_are_postings(spark):
    """Copies have one node: their n-grams are nobody else's, and each posting of a node is there once."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(200)) for _ in range(300)]
    texts += texts[:150] + [t + " end" for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    table, counts = ngram_join.described(docs, "doc_id", "text", 3)
    assert counts.sum() == 455 * 198 + 5
    postings = ngram_join.prefix_postings(docs, table, "text", 3, 90, counts, 26).collect()
    keys = Counter(r.key for r in postings)
    assert len({(r.key, r.node) for r in postings}) == len(postings)
    assert sum(n > 1 for n in keys.values()) > 50 and sum(n == 1 for n in keys.values()) < 50


def test_counters_do_not_put_prefixes_close_together():
    """Of many sets in the order of counters that all n-grams fill, the prefixes spread over the prefilter's slots."""
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2) + np.uint64(1)) for _ in range(100)]
    sets = [ngram_join.mixed(s) for s in sets]
    counts = np.zeros(1 << ngram_join.COUNT_BITS, np.int64)
    counts[: len(counts) * 7 // 8] = 50  # an eighth of the counters is low
    low = [ngram_join.prefix_of(s, counts, 43.75, 90)[0] for s in sets]
    top = np.concatenate(low) >> np.uint64(61)
    assert np.bincount(top.astype(int), minlength=8).max() < len(top) / 4


def test_counts_are_packed_in_the_type_they_need():
    import numpy as np

    for most in (7, 255, 256, 70_000, 1 << 33):
        block = np.arange(1 << ngram_join.BLOCK_BITS) % 7
        block[5] = most
        assert (ngram_join.unpacked(ngram_join.packed(block)) == block).all()
        assert ngram_join.narrow(block).max() == most
