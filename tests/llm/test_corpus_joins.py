"""Mask search, n-gram join and spelling variants against brute force; their edge cases."""

import math
import random
import zlib

import numpy as np
import pytest
from conftest import LONG

from millwatch.llm import ngramjoin, ranked, spelling

ROW = "doc_id long, text string, item_id string, score double, n long, rank int"


def clashing(spark, rows):
    """Rows (id, text) with extra columns that are named like the operators' own."""
    return spark.createDataFrame([(i, t, "x", -5.0, -7, -1) for i, t in rows], ROW).repartition(3)


# ---------------------------------------------------------------- ranked search

def terms(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text or "")
    return [t for t in fold.split(" ") if t]


def brute_search(docs, items, k):
    each = [(i, terms(t)) for i, t in docs]
    each = [(i, ts) for i, ts in each if ts]
    n, total = len(each), sum(len(ts) for _, ts in each)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = set()
    for item, ts in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in d for _, d in each) + 1))) for t in ts}
        scored = []
        for i, d in each:
            m = 10 + 90 * len(d) * n // total
            score = sum(weight[t] * (10**9 * d.count(t) // (1000 * d.count(t) + 8 * m)) for t in ts if t in d)
            if score > 0:
                scored.append((-score, i is None, i))
        out |= {(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("slice_bytes", [256_000, 60_000])
def test_search_equals_brute_force(spark, corpus, slice_bytes):
    r = random.Random(3)
    items = [(f"i{k}", " ".join(f"W{r.randrange(320)}" for _ in range(r.randint(1, 90)))) for k in range(12)]
    items += [("i0", "naïve, CAFÉ!"), ("none", None), ("blank", " -- "), (None, "w1 w2"), ("long", LONG), ("unknown", "zzz")]
    rows = [*corpus, (None, "w1 w2 w3"), corpus[0], corpus[0]]
    docs = clashing(spark, rows)
    found = ranked.search(docs, spark.createDataFrame(items, "item_id string, text string"), k=7, slice_bytes=slice_bytes)
    assert [f.dataType.simpleString() for f in found.schema] == ["string", "int", "bigint", "bigint"]
    assert {tuple(x) for x in found.collect()} == brute_search(rows, items, 7)


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame([("a", "w1")], "item_id string, text string")
    assert ranked.search(docs([]), items).count() == 0
    assert ranked.search(docs([(1, "w1")]), items.limit(0)).count() == 0


def test_masks_below_the_floor_are_not_scored():
    """A mask whose maximum is below the k-th score is left out, and the result is that of scoring all."""
    rng = np.random.default_rng(5)
    tf = (rng.random((20, 3000)) < rng.random((20, 1)) * 0.3) * rng.integers(1, 4, (20, 3000))
    weight, m, ids = rng.integers(0, 5000, 20), rng.integers(20, 300, 3000), rng.permutation(3000)
    best = ranked.Best(10)
    scored = ranked.evaluate(best, tf, weight, m, ids)
    every = (weight[:, None] * ranked.gains(tf, m)).sum(axis=0)
    want = np.lexsort((ids, -every))[:10]
    assert best.score.tolist() == every[want].tolist() and best.ids.tolist() == ids[want].tolist()
    assert scored < 1500
    assert ranked.evaluate(best, tf[:1], weight[:1], m, ids) == 0


def test_masks_wider_than_a_word():
    present = np.random.default_rng(1).random((150, 40)) < 0.5
    present[:, 7] = present[:, 3]
    distinct, order, starts = ranked.grouped(ranked.masks(present))
    groups = {tuple(sorted(order[a:b].tolist())) for a, b in zip(starts, starts[1:])}
    assert (3, 7) in groups and len(groups) == 39 == len(distinct)


def test_discounts_beyond_64_bits():
    n = np.array([3, 10**7], dtype=np.int64)
    assert ranked.discounts(n, 10**12, 10**13).tolist() == [10 + 27, 10 + 9 * 10**7]


# ---------------------------------------------------------------- n-gram join

def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in low.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    return {tuple(ws[i:i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def brute_classes(rows, width, share):
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in sets:
        for b in sets:
            c = len(sets[a] & sets[b])
            if a < b and c and 100 * c >= share * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def edited(r, ws, edits):
    ws = list(ws)
    for _ in range(edits):
        ws[r.randrange(len(ws))] = f"new{r.randrange(10**6)}"
    return " ".join(ws)


def family(seed, size, words):
    """One text and copies of it with up to a tenth of the words replaced: pairs on both sides of the threshold."""
    r = random.Random(seed)
    base = [f"b{seed}x{r.randrange(500)}" for _ in range(words)]
    return [edited(r, base, r.randint(0, max(1, words // 14))) for _ in range(size)]


@pytest.mark.parametrize(("width", "share"), [(3, 90), (2, 60)])
def test_join_equals_brute_force(spark, corpus, width, share):
    rows = corpus + [(200 + k, t) for k, t in enumerate(family(1, 40, 60) + family(2, 25, 130) + family(3, 20, 9))]
    found = ngramjoin.linked_classes(clashing(spark, rows), width, share)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_classes(rows, width, share)


def test_join_through_blocks(spark, docs, monkeypatch):
    """A large column in many blocks, with no common columns put behind, gives what pairs give."""
    rows = [(k, t + " shared end of every text") for k, t in enumerate(family(4, 70, 30) + family(5, 50, 45))]
    want = brute_classes(rows, 3, 90)
    assert len({c for _, c in want.values()}) not in (1, 120)
    for name, value in (("SMALL", 2), ("BLOCK", 16), ("PAIRS", 50), ("FREQUENT", 10**6)):
        monkeypatch.setattr(ngramjoin, name, value)
    found = ngramjoin.linked_classes(docs(rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == want


def test_join_of_odd_rows(spark, docs):
    rows = [(None, "a b c d"), (None, None), (5, "a b c d"), (3, "A b  c d"), (3, "A b  c d"), (9, ""), (10, None), (11, LONG), (12, LONG + "end")]
    found = sorted((tuple(r) for r in ngramjoin.linked_classes(docs(rows)).collect()), key=str)
    assert found == sorted([(None, 2, None), (None, 0, None), (5, 2, 3), (3, 2, 3), (3, 2, 3), (9, 0, 9), (10, 0, 10),
                            (11, 1, 11), (12, 2, 12)], key=str)
    assert ngramjoin.linked_classes(docs([])).count() == 0


def test_bounds_lose_no_link():
    """Sketches of any two widths never differ in more bits than the rows differ in entries."""
    rng = np.random.default_rng(2)
    rows, ids = [], []
    for size in (5, 60, 70, 130, 140, 1000, 1100):
        base = rng.integers(0, 1 << 62, size).astype(np.uint64)
        rows += [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 62, k).astype(np.uint64)])) for k in range(0, 5)]
    n, sketches = np.array([len(r) for r in rows]), [ngramjoin.sketch(r).tobytes() for r in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a)]
    a, b = (np.array(x) for x in zip(*pairs))
    good = ngramjoin.close(a, b, n, sketches, 90)
    for x, y, g in zip(a, b, good):
        c = len(np.intersect1d(rows[x], rows[y]))
        assert g or 100 * c < 90 * (n[x] + n[y] - c)
    assert good.mean() < 0.5


@pytest.mark.parametrize("n", range(1, 60))
def test_leading_columns_meet(n):
    """With the least overlap that links, the columns that differ cannot fill the leading ones."""
    for other in range(n, n * 10 // 9 + 1):
        overlap = ngramjoin.needed(n, other, 90)
        assert 100 * overlap >= 90 * (n + other - overlap) > 0
        if overlap <= n:
            assert ngramjoin.leading(n, 90) > n - overlap and ngramjoin.leading(other, 90) > other - overlap


# ---------------------------------------------------------------- spelling variants

def distance_is_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts, ratio=10):
    near = {w: [v for v in counts if distance_is_one(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def vocabulary(seed, size):
    r = random.Random(seed)
    counts = {}
    for _ in range(size):
        w = "".join(r.choice(["an", "en", "é", "th", "i", "o"]) for _ in range(r.randint(3, 6)))
        for _ in range(r.randint(0, 3)):
            p = r.randrange(len(w) + 1)
            w = w[:p] + r.choice(["", "a", "é", "日"]) + w[p + r.randint(0, 1):]
        counts[w or "x"] = r.choice([1, 2, 9, 20, 300, 4000])
    return counts


@pytest.mark.parametrize(("upper", "block", "probes"), [(None, 1 << 14, 1 << 16), (5, 3, 4), (32, 7, 50)])
def test_variants_equal_brute_force(spark, monkeypatch, upper, block, probes):
    counts = vocabulary(upper or 1, 350) | {"m" * 60: 5, "m" * 61: 80, "m" * 60 + "n": 900, "q" * 3000: 2, "q" * 2999 + "r": 31}
    if upper:
        monkeypatch.setattr(spelling, "levels", lambda words: upper)
    near = spelling.near_words
    monkeypatch.setattr(spelling, "near_words", lambda words: near(words, block, probes))
    words = spark.createDataFrame([(w, n, "own") for w, n in counts.items()], "word string, n long, form string").repartition(4)
    found = spelling.spelling_variants(words)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()} == brute_variants(counts)


def test_forms_are_followed(spark):
    counts = {"abcdefg": 1, "abcdefh": 10, "abcdehh": 100, "abcdhhh": 1000, "abchhhh": 10_000, "lonely": 3, "tie aaa": 1, "tie aab": 10, "tie aac": 10}
    found = {r.word: r for r in spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert found["abcdefg"].root == "abchhhh" and found["abcdefg"].form == "abcdefh"
    assert found["tie aaa"].form == "tie aab" and found["lonely"].n_near == 0 and found["lonely"].root == "lonely"
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_runs_and_deletions(spark, corpus):
    r = random.Random(9)
    long_words = ["Wanderung", "héritage", "étéétéété", "straße", "naïveté", "x" * 40]
    rows = corpus + [(300 + k, ", ".join(r.choice(long_words) for _ in range(60)) + " Œuvrement 12") for k in range(20)]
    rows += [(None, "Wanderung " * 5), rows[-1]]
    want = {}
    for i, t in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        run = ""
        for c in text + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{i}:{run}".encode())
                if i is not None and h % 31 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                if len(run) >= 7:
                    want[run] = want.get(run, 0) + 1
            run = ""
    found = {x.word: x.n for x in spelling.run_counts(clashing(spark, rows)).collect()}
    assert found == {w: n for w, n in want.items() if n >= 2}
    assert any(w not in "wanderung héritage étéétéété naïveté" + "x" * 40 for w in found)
