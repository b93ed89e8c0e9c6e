"""The pipeline's stages against brute force on a small corpus."""

import collections
import random
import re
import zlib

import corpus_pipeline
from pyspark.sql import functions as F
from test_corpus_brute import ppm


def test_pipeline(spark, docs, folder, corpus):
    r = random.Random(9)
    item = " ".join(f"item{i}" for i in range(15))
    rows = [(i, t, r.choice(["en", None]), r.choice(["a", "b", "c"])) for i, t in corpus if i not in (81,)]
    rows += [(200, f"{item} tail", "en", "a"), (201, "123 456", "en", "b"), (202, " ".join(f"long{i}" for i in range(400)) + " " + item, "en", "c")]
    root = folder(documents=docs(rows), benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    columns = docs([]).columns
    frame, ids = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, root)
        ids[name] = {x["doc_id"] for x in frame.select("doc_id").collect()}
        assert name == "sharding" or frame.columns == columns
    text = {i: t or "" for i, t, *_ in rows}
    # A text with a letter goes if its code is longer than twice what held-out texts of the one language take, and 128 bits.
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    told = [(i, t) for i, t, name, _ in rows if name == "en" and t]
    learned = [t or "" for i, t, name, _ in rows if name == "en" and t is not None and not held(i)]
    bits = {i: ppm(learned, t) for i, t in text.items() if any(c.isalpha() for c in t)}
    own = [i for i, t in told if held(i) and i in bits]
    rate = sum(bits[i] for i in own) / sum(len(text[i].encode()) + 1 for i in own)
    want = {i for i, b in bits.items() if b <= 128 + 2 * rate * (len(text[i].encode()) + 1)}
    assert ids["language"] == want and {i for i, t in text.items() if i < 68} <= want < set(bits)
    sets = {}
    for i in want:
        ws = [w for w in re.split("[ \t-\r]+", text[i]) if w]
        ws = ["".join(c.lower() if c.isascii() else c for c in w) for w in ws]
        sets[i] = {tuple(ws[k:k + 5]) for k in range(max(1, len(ws) - 4))}
    root_ = {i: i for i in want}
    def find(x):
        while root_[x] != x:
            x = root_[x]
        return x
    for a in sorted(want):
        for b in sorted(want):
            common = len(sets[a] & sets[b])
            if a < b and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root_[max(x, y)] = min(x, y)
    assert ids["near_duplicates"] == {find(i) for i in want}
    assert ids["decontamination"] == ids["near_duplicates"] - {200}
    out = corpus_pipeline.run(spark, root)
    slots = collections.defaultdict(list)
    for x in out.collect():
        slots[x["shard"]].append(x["slot"])
        assert x["text"] == text[x["doc_id"]]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    empty = folder(documents=docs([]), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, empty).count() == 0
