"""Operators without SQL against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwatch.llm import decontaminate, fmindex, graph, langid, lines, minhash, mixing, quality, shards, substrings, toxicity, warc
from millwatch.llm.common import scratch

LABELS = "doc_id long, quality int, toxic int"


def test_minimax_is_optimal():
    rng = np.random.default_rng(1)
    for t in range(600):
        n, k = rng.integers(1, 10), rng.integers(1, 6)
        s = rng.integers(1, 30, n)
        if t % 3 == 0:
            s[rng.integers(n)] = 500
        b = [*shards.minimax(s, k).tolist(), n]
        assert b[0] == 0 and all(x <= y for x, y in itertools.pairwise(b))
        best = min(max(s[x:y].sum() for x, y in itertools.pairwise((0, *c, n))) for c in itertools.combinations_with_replacement(range(n + 1), k - 1))
        assert max(s[x:y].sum() for x, y in itertools.pairwise(b)) == best


def test_shards(spark, docs, folder, corpus, monkeypatch):
    monkeypatch.setattr(shards, "PART_ROWS", 2)
    rows = [*corpus, *((1000 + i, "hot") for i in range(50)), (None, "x"), (5, dict(corpus)[5])]
    got = shards.op5_minimax_shards(spark, folder(documents=docs(rows))).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(40))
    text = dict(rows)
    where = collections.defaultdict(set)
    for r in got:
        t = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 16, zlib.crc32(t), "bytes", None)
        where[t].add(r["shard"])
    assert all(len(v) == 1 for v in where.values())
    assert shards.op5_minimax_shards(spark, folder(documents=docs([]))).count() == 0


def test_mix(spark, docs, folder):
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 60))), None, r.choice(["b", "a", "z", None, "é", "hot", "hot", "hot"])) for i in range(400)]
    rows += [(500, None, None, "a"), (501, "", None, "only blank"), (None, "x y", None, "a"), (3, rows[3][1], None, rows[3][3])]
    root = folder(documents=docs(rows))
    got = mixing.op6_mix_sources(spark, root).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.op6_mix_sources(spark, root).collect()))
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    held, total = set(), sum(size.values())
    while True:
        rest = (total - sum(3 * size[s] for s in held)) / sum(weight[s] for s in order if s not in held)
        above = {s for s in order if s not in held and 3 * size[s] < weight[s] * rest}
        if not above:
            break
        held |= above
    goal = {s: 3 * size[s] if s in held else weight[s] * rest for s in order}
    of = {(i, len((t or "").split())): s for i, t, _, s in rows}
    taken = collections.Counter()
    for x in got:
        s = of[x["doc_id"], x["size"]]
        assert x["source_size"] == size[s] and x["target"] == pytest.approx(goal[s]) and 0 <= x["taken"] <= 3 * x["size"]
        taken[s] += x["taken"]
    for s in order:
        assert abs(taken[s] - goal[s]) <= 64 * (2 + math.log2(total / 64 + 2))
    assert mixing.op6_mix_sources(spark, folder(documents=docs([]))).count() == 0


def test_mix_of_small_sources(spark, docs):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randint(1, 40)), None, f"s{i % 300}") for i in range(900)]
    rows += [(1000 + i, "w " * 300, None, f"large{i % 3}") for i in range(60)]
    rows += [(2000, "only", None, "tiny"), (2001, "", None, "blank")]
    frame = docs(rows)
    got, slots = (x.collect() for x in mixing.mix(frame))
    source, goal, size, taken = {i: s for i, _, _, s in rows}, {}, {}, collections.Counter()
    for x in got:
        s = source[x["doc_id"]]
        goal[s], size[s] = x["target"], x["source_size"]
        taken[s] += x["taken"]
        assert (x["first_slot"] is None) == (x["taken"] == 0)
    assert sum(v < 200 for v in size.values()) > 290
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in goal)
    # The slots of a source follow each other through its stream and read what is taken; no document is read before its slot.
    total, read = sum(size.values()), collections.defaultdict(list)
    for x in sorted(slots):
        read[x["key"][1:]].append((x["rank"], x["start"], x["words"]))
    assert set(read) == {s for s in goal if goal[s]} and {x["slot"] for x in slots} == set(range(1 << math.ceil(math.log2(total / 64))))
    for s, each in read.items():
        assert [k for k, *_ in each] == list(range(len(each)))
        assert [b for _, b, _ in each] == [sum(w for *_, w in each[:k]) for k in range(len(each))] and sum(w for *_, w in each) == taken[s]
    first = {(x["key"][1:], x["start"]): x["slot"] for x in slots}
    for s in read:
        mine = [x for x in got if source[x["doc_id"]] == s and x["taken"]]
        assert min(x["first_slot"] for x in mine) == first[s, 0] and {x["first_slot"] for x in mine} <= {v for (k, _), v in first.items() if k == s}
    # Slot by slot: a slot's words are those of the documents that lie between its ends in the shuffled stream, pass after pass.
    sized = frame.select("doc_id", mixing.key().alias("key"), mixing.word_count(F.col("text")).alias("size"))
    by_slot = collections.Counter()
    stream = collections.defaultdict(list)
    for x in mixing.streams(sized).orderBy("key", "start").collect():
        stream[x["key"][1:]] += [x["doc_id"]] * x["size"]
    for x in slots:
        s = x["key"][1:]
        by_slot.update(stream[s][k % size[s]] for k in range(x["start"], x["start"] + x["words"]))
    assert {x["doc_id"]: x["taken"] for x in got if x["taken"]} == dict(by_slot)
    copies = collections.Counter(x["doc_id"] for x in mixing.mixed_documents(frame).select("doc_id").collect())
    words, longest = collections.Counter(), collections.Counter()
    for i, t, _, s in rows:
        words[s] += copies[i] * len(t.split())
        longest[s] = max(longest[s], len(t.split()))
    assert all(abs(words[s] - goal[s]) <= longest[s] / 2 + 0.5 for s in goal)


def test_schedule_is_low_discrepancy(spark):
    goals = spark.createDataFrame([("a", 0, 0.0, 0.2), ("b", 1, 0.2, 0.5), ("c", 2, 0.5, 1.0)], "key string, place long, low double, high double")
    rows = sorted(mixing.schedule(goals, 9).collect())
    assert [r["slot"] for r in rows] == list(range(512))
    seen = collections.Counter()
    for i, r in enumerate(rows, 1):
        assert r["rank"] == seen[r["key"]]
        seen[r["key"]] += 1
        for k, share in (("a", 0.2), ("b", 0.3), ("c", 0.5)):
            assert abs(seen[k] - share * i) <= 1 + math.log2(i + 1)


def test_edit_distance():
    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d = d, [i]
            for j, y in enumerate(b, 1):
                d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
        return d[-1]
    bits = lambda x: [v & (1 << 64) - 1 for v in lines.bag(x)]
    r = random.Random(1)
    for _ in range(4000):
        a = "".join(r.choice("abé") for _ in range(r.randint(0, 14)))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            i = r.randint(0, len(b))
            b[i:i + r.randint(0, 1)] = [r.choice("abé")] * r.randint(0, 1)
        for k in (1, 2, 3):
            assert lines.edit_distance(a, "".join(b), k) == min(plain(a, "".join(b)), k + 1)
        turned = sum((x ^ y).bit_count() for x, y in zip(bits(a), bits("".join(b)), strict=True))
        assert turned <= 4 * plain(a, "".join(b))


def linked(a, b, bands=lines.BANDS):
    k = max((e for least, e in bands if min(len(a), len(b)) >= least), default=0)
    return k > 0 and abs(len(a) - len(b)) <= k and lines.edit_distance(a, b, k) <= k


@pytest.mark.parametrize("bands", [lines.BANDS, ((3, 1), (12, 2), (25, 3), (45, 4)), ((30, 1),), ()])
def test_bands_of_edits(spark, docs, bands):
    """Links equal brute force in every band and across their borders."""
    r = random.Random(15)
    base = ["".join(r.choice("abcdé ") for _ in range(n)).strip() + "." for n in [2, 4, 6, 7, 8, 10, 11, 12, 18, 19, 20, 21, 24, 25, 26, 44, 45, 46, 60]]
    def edited(x):
        x = list(x)
        for _ in range(r.randint(0, 4)):
            i = r.randrange(len(x) + 1)
            x[i:i + r.randint(0, 1)] = r.choice(["", "z", "q"])
        return "".join(x)
    rows = [(i, "\n".join(edited(r.choice(base)) for _ in range(6))) for i in range(60)]
    frame = docs(rows)
    text = {x["id"]: x["line"] for x in lines.lines_of(frame).collect()}
    got = {frozenset((text[x["a"]], text[x["b"]])) for x in lines.links(frame, bands=bands).collect()}
    want = {frozenset(p) for p in itertools.combinations(set(text.values()), 2) if linked(*p, bands)}
    assert got == want and bool(want) == bool(bands)


def test_line_join(spark, docs, folder):
    r = random.Random(5)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randint(6, 40))).strip() + "." for _ in range(25)]
    def edited(x):
        x = list(x)
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(x))
            x[i:i + r.randint(0, 1)] = r.choice(["", "z", "q"])
        return "".join(x)
    rows = [(i, "\n".join(edited(r.choice(base)) if r.random() < 0.8 else r.choice(["", "short", "shirt", "  "]) for _ in range(r.randint(0, 8)))) for i in range(60)]
    rows += [(100, None), (101, "\n\n"), (102, "x" * 50_000), (103, "x" * 49_999), (None, base[0])]
    occ = [(i, p, x) for i, t in sorted(r_ for r_ in rows if r_[0] is not None) for p, x in enumerate((t or "").split("\n")) if x.split()]
    unique = sorted({x for *_, x in occ})
    degree, root = collections.Counter(), {x: x for x in unique}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(unique, 2):
        if linked(a, b):
            degree[a] += 1
            degree[b] += 1
            root[find(a)] = find(b)
    first, want = {}, {i: [0, 0, []] for i, _ in rows}
    for i, p, x in occ:
        first.setdefault(find(x), (i, p))
        w = want[i]
        w[0] += 1
        w[1] += degree[x]
        if first[find(x)] != (i, p):
            w[2].append(p)
    got = lines.op7_line_edit_join(spark, folder(documents=docs(rows))).collect()
    assert len(got) == len(rows) and sum(degree.values()) > 20
    for g in got:
        assert [g["n_lines"], g["n_links"], g["dropped_lines"]] == want[g["doc_id"]] and g["n_dropped"] == len(g["dropped_lines"])
    assert lines.op7_line_edit_join(spark, folder(documents=docs([]))).count() == 0


def test_line_classes(spark, docs, folder):
    r = random.Random(6)
    base = ["".join(r.choice("abcd ") for _ in range(30)).strip() + "." for _ in range(12)]
    def edited(x):
        i = r.randrange(len(x))
        return x[:i] + r.choice(["", "z", "q"]) + x[i + r.randint(0, 1):]
    rows = [(i, "\n".join(edited(edited(r.choice(base))) if r.random() < 0.8 else r.choice(["", "short", "  "]) for _ in range(r.randint(0, 6)))) for i in range(50)]
    rows += [(100, None), (None, base[0])]
    occ = [(i, p, x) for i, t in rows if i is not None for p, x in enumerate((t or "").split("\n")) if x.strip()]
    near = collections.defaultdict(set)
    for (_, _, a), (_, _, b) in itertools.combinations(occ, 2):
        if a != b and linked(a, b):
            near[a].add(b)
            near[b].add(a)
    name = {}
    for i, p, x in sorted(occ):
        todo = [] if x in name else [x]
        while todo:
            y = todo.pop()
            if y not in name:
                name[y] = (i, p)
                todo += near[y]
    want = collections.defaultdict(list)
    for i, p, x in occ:
        want[i].append((p, *name[x], len(near[x])))
    got = lines.op7_line_edit_join(spark, folder(documents=docs(rows))).collect()
    assert len(got) == len(rows) and any(len(x) > 1 for x in near.values())
    assert [(g["doc_id"], [tuple(x) for x in g["line_classes"]]) for g in got if g["line_classes"] != want[g["doc_id"]]] == []


def test_fm_index():
    rng = np.random.default_rng(2)
    for sigma in (1, 2, 5, 300):
        s = np.concatenate((rng.integers(1, sigma + 1, 400), [0]))
        index = fmindex.FMIndex(s, 6)
        starts = np.arange(len(s) - 7)
        at, low = index.repeats(s, starts, 6)
        grams = [tuple(s[i:i + 6]) for i in starts]
        count = collections.Counter(grams)
        assert set(at.tolist()) == {i for i in starts if count[grams[i]] > 1}
        by = collections.defaultdict(set)
        for i, x in zip(at.tolist(), low.tolist(), strict=True):
            by[grams[i]].add(x)
        assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(1000, i) for i in range(1001, 1300)]
    root = {}
    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, share in enumerate((0.2, 0.5, 0.75, 0.9)):
        for t in range(30):
            common = rng.integers(0, 1 << 63, int(400 * share), dtype=np.uint64)
            rest = [rng.integers(0, 1 << 63, (400 - len(common)) // 2, dtype=np.uint64) for _ in range(2)]
            planes = []
            for x in rest:
                planes.append([p[0].tolist() for p in minhash.planes(minhash.minima(np.concatenate((common, x)))[None])])
            rows.append((share, {"low": planes[0][0], "high": planes[0][1]}, {"low": planes[1][0], "high": planes[1][1]}))
    side = "struct<low: array<long>, high: array<long>>"
    got = spark.createDataFrame(rows, f"share double, x {side}, y {side}").groupBy("share").agg(F.avg(minhash.estimate("x", "y")).alias("e")).collect()
    assert all(abs(r["e"] - r["share"]) < 0.04 for r in got)


def test_archive_round_trip(spark):
    rows = [(i, f"http://h{i % 7}.example.org/p{i % 11}", f"<p>{i % 5}</p>" * (i % 13)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    root = scratch(spark, "warc-test")
    captures = warc.write(pages, root)
    index = warc.build_index(captures, root, block_lines=7)
    wanted = spark.createDataFrame([("http://h3.example.org/p4",), ("http://h0.example.org/p0#part",), ("http://nowhere.example/",), (None,)], "url string")
    found = {r["page_id"] for r in warc.lookup(index, wanted).collect()}
    assert found == {i for i, u, _ in rows if u in ("http://h3.example.org/p4", "http://h0.example.org/p0")}
    records = {r["page_id"]: r for r in warc.fetch(captures, root).collect()}
    for i, u, html in rows:
        payload = html.encode()
        record = records[i]
        assert record["url"] == u and record["payload_digest"] == hashlib.sha256(payload).hexdigest()
        full = record if record["refers_to"] is None else records[record["refers_to"]]
        assert bytes(full["payload"]) == payload and full["record_type"] == "response"


def test_languages(spark, docs, folder):
    r = random.Random(6)
    parts = {"aa": ["ka", "to", "mi", "ren"], "bb": ["sch", "ung", "er", "lich"], "cc": ["éa", "oux", "le", "que"]}
    text = lambda k, n: " ".join("".join(r.choices(parts[k], k=r.randint(1, 4))) for _ in range(n))
    rows = [(i, text(k := r.choice(list(parts)), r.randint(3, 40)), k if r.random() < 0.9 else None, "s") for i in range(500)]
    rows += [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 34 !!", "bb", "s"), (None, text("cc", 20), "cc", "s"), (903, text("bb", 40_000), None, "s"),
             (904, "日本語 текст", None, "s"), (905, text("aa", 9), None, "s"), (905, text("aa", 9), None, "s")]
    got = langid.op10_language_id(spark, folder(documents=docs(rows))).collect()
    assert len(got) == len(rows)
    said = {x["doc_id"]: x for x in got}
    truth = {i: (k, t) for i, t, k, _ in rows}
    out = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 500]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in out)
    right = [x["lang_pred"] == truth[x["doc_id"]][0] for x in out if x["held_out"] and truth[x["doc_id"]][0]]
    assert len(right) > 50 and np.mean(right) > 0.98
    assert [(said[i]["lang_pred"], said[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert said[903]["lang_pred"] == "bb" and said[904]["lang_pred"] in parts and said[None]["lang_pred"] == "cc" and said[None]["held_out"]
    bare = docs([(1, "words here", None, "s")])
    assert langid.predict(bare, langid.learn(bare)).first()["lang_pred"] == "und"
    assert langid.op10_language_id(spark, folder(documents=docs([]))).count() == 0


def ppm(training, text, order=langid.ORDER):
    """Bits of a text by an independent PPM-C over dictionaries."""
    def fold(t):
        return [0] * order + [32 if b <= 32 or b == 127 else b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in t.encode()] + [0]
    tree = collections.defaultdict(collections.Counter)
    for t in training:
        f = fold(t)
        for i in range(order, len(f)):
            for k in range(order + 1):
                tree[tuple(f[i - k:i])][f[i]] += 1
    f, bits = fold(text), 0.0
    for i in range(order, len(f)):
        for k in range(order, -1, -1):
            seen = tree.get(tuple(f[i - k:i]))
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if f[i] in seen:
                bits += math.log2(whole / seen[f[i]])
                break
            bits += math.log2(whole / len(seen))
        else:
            bits += 8
    return bits


@pytest.fixture(scope="module")
def tongues():
    r = random.Random(12)
    parts = {"aa": ["tha", "ing", "er"], "bb": ["ción", "ll", "que"], "日本": ["の", "日本", "です"], "zz": ["tha", "que", "xy"]}
    return {k: [" ".join("".join(r.choice(v) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 12))) for _ in range(15)] for k, v in parts.items()}


def test_code_lengths_equal_an_independent_ppm(spark, docs, tongues):
    rows = [(k * 100 + i, t, name, "s") for k, (name, each) in enumerate(tongues.items()) for i, t in enumerate(each)]
    model = langid.fit(docs(rows))
    assert model.languages == sorted(tongues, key=str.encode)
    probes = ["the thing", "", "ZZ 19 que", "です の日本", "\x00\x7f\t", "ñ" * 30, *(each[0] for each in tongues.values())]
    whole = langid.code_lengths(model, [p.encode() for p in probes])
    for k, name in enumerate(model.languages):
        for p, got in zip(probes, whole[k]):
            assert got / langid.UNIT == pytest.approx(ppm(tongues[name], p), abs=1e-3 + 1e-4 * len(p.encode()))
    # neither blocks nor batches change a sum
    assert (langid.code_lengths(model, [p.encode() for p in probes], block=7) == whole).all()
    assert [langid.code_lengths(model, [p.encode()])[0, 0] for p in probes] == whole[0].tolist()


def test_bounded_tables_keep_the_frequent_contexts(spark, docs, tongues):
    """Many noisy labels and a small bound: tables stay within it, frequent languages are still told apart."""
    rows = [(k * 100 + i, t, name, "s") for k, (name, each) in enumerate(tongues.items()) for i, t in enumerate(each * 3)]
    rows += [(10_000 + i, f"noise{i}", f"label{i}", "s") for i in range(200)]
    model = langid.fit(docs(rows), table_bytes=8 * 204 * 300)
    assert len(model.languages) == 204 and all(len(level.keys) <= 300 for level in model.levels)
    cost = langid.code_lengths(model, [tongues["aa"][0].encode(), tongues["日本"][1].encode()])
    assert [model.languages[k] for k in cost.argmin(axis=0)] == ["aa", "日本"]


def test_texts_of_unlearned_languages_go(spark, docs):
    r = random.Random(5)
    words = [["tha", "ing", "er", "on"], ["ción", "ll", "que", "os"]]
    text = lambda v, n: " ".join("".join(r.choice(v) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, text(words[i % 2], r.randint(1, 80)), ("aa", "bb")[i % 2], "s") for i in range(400)]
    rows += [(1000 + i, text(["wkj", "zvq", "pyx", "gmf"], 60), None, "s") for i in range(20)]
    rows += [(2000, "wkj", None, "s"), (2001, None, "aa", "s"), (2002, "12", None, "s")]
    kept = {x["doc_id"] for x in langid.accepted(docs(rows), langid.learn(docs(rows))).collect()}
    assert kept == {i for i in range(400)} | {2000}  # too short to tell stays
    assert langid.accepted(docs(rows[-3:]), langid.learn(docs(rows[-3:]))).count() == 0


def test_toxicity(spark, docs, folder):
    r = random.Random(8)
    clean = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}n" for i in range(200)]
    bad = ["scoundrel", "villain", "grubbers", "grubbing", "grubbed"]
    rows, labels = [], []
    for i in range(400):
        ws = r.choices(clean, k=r.randint(5, 60))
        toxic = i % 4 == 0
        for _ in range(r.randint(1, 8) if toxic else 0):
            ws.insert(r.randrange(len(ws)), r.choice(bad))
        rows.append((i, " ".join(ws)))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (902, "12 !!"), (None, "villain villain")]
    labels += [(None, 1, 1), (5, None, None), (7777, 0, 1), (0, 1, 1)]
    got = toxicity.op9_toxicity_severity(spark, folder(documents=docs(rows), labels=spark.createDataFrame(labels, LABELS))).collect()
    assert len(got) == len(rows)
    for x in got:
        if x["doc_id"] is not None and x["doc_id"] < 400:
            assert x["toxic"] == (x["doc_id"] % 4 == 0), x
        assert 0 <= x["severity"] <= 3
    assert [x["severity"] for x in got if x["doc_id"] in (900, 901, 902)] == [0, 0, 0]
    count = {i: sum(w in bad for w in (t or "").split()) for i, t in rows}
    few = np.mean([x["severity"] for x in got if count.get(x["doc_id"]) in (1, 2)])
    many = np.mean([x["severity"] for x in got if count.get(x["doc_id"], 0) >= 6])
    assert many > few + 0.5
    none = spark.createDataFrame([], LABELS)
    assert toxicity.op9_toxicity_severity(spark, folder(documents=docs(rows), labels=none)).agg(F.max("severity")).first()[0] == 0


def test_varied_toxic_words(spark, docs, folder):
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    clean, bad = [word() for _ in range(200)], [word() for _ in range(200)]
    rows, labels = [], []
    for i in range(8400):  # of 4000 toxic training texts, 20 have any one bad word
        ws = r.choices(clean, k=10)
        if i % 2:
            ws.insert(r.randrange(10), bad[i // 2 % 200])
        rows.append((i, " ".join(ws)))
        if i < 8000:
            labels.append((i, 1, i % 2))
    tables = {"documents": docs(rows), "labels": spark.createDataFrame(labels, LABELS)}
    got = toxicity.op9_toxicity_severity(spark, folder(**tables)).where("doc_id >= 8000").collect()
    assert len(got) == 400
    assert np.mean([x["toxic"] == (x["doc_id"] % 2 == 1) for x in got]) > 0.99
    assert all((x["severity"] > 0.5) == (x["doc_id"] % 2 == 1) for x in got)
    # The statistic against the ratio of likelihoods, at zero counts too.
    training = spark.createDataFrame([(i, int(i < 40), f"common {'rare' if i < 9 else ''} {'mixed' if i % 4 else ''}") for i in range(100)], "doc_id long, label long, text string")
    assert {f for f, o in toxicity.vocabulary(training, 99, 5) if o > 2} == {b"rare"}


def test_ablation(spark, docs, corpus):
    entries = quality.ledger(docs(corpus))
    rows = entries.collect()
    got = {r["rule"]: r for r in quality.ablation(entries).collect()}
    whole = quality.mask(quality.POLICIES[quality.CURRENT])
    for i, rule in enumerate(quality.RULES):
        fail = [r["fail_bits"] & whole for r in rows]
        assert got[rule.name]["failed"] == sum(f >> i & 1 for f in fail)
        assert got[rule.name]["only_this"] == sum(f == 1 << i for f in fail)
        assert got[rule.name]["kept_without"] == sum(f & ~(1 << i) == 0 for f in fail)


def test_cut_spans(spark, docs):
    item = " ".join(f"t{i}" for i in range(15))
    rows = [(1, f"before, {item.upper()}. after"), (2, "nothing here"), (3, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(docs(rows), bench).collect()}
    assert got == {1: "before, . after", 2: "nothing here", 3: None}


def test_removed_ranges(spark, docs):
    same = " ".join(f"s{i}" for i in range(25))
    got = {r["doc_id"]: r for r in substrings.deduplicate(docs([(1, f"x {same}"), (2, f"{same} y z"), (None, same)])).collect()}
    assert {i for x in got[2]["ranges"] for i in range(*x)} == set(range(25)) and got[2]["n_removed"] == 25 and got[1]["n_removed"] == 0 and got[None]["n_removed"] == 0
