"""Ranked lexical search by presence-mask grouping.

Terms are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. All documents are scored for each item of a
stated query set; the items are collected in slices of a bounded number of bytes, one slice after another, so that what is
broadcast is bounded whatever the number of items.

1. One pass over the texts keeps of every document its length and the frequencies of the slice's terms, and of every
   task the number of its documents that hold a term: document frequencies and corpus sums are exact and whole.
2. The kept rows are read in blocks. A block is a table of frequencies by term; for an item the rows of its terms
   become presence bits, packed to a mask per document, and equal masks are one group. A mask's maximum score
   follows from its terms, the block's largest frequencies and its shortest document. Groups are evaluated by descending
   maximum, exactly, until the next maximum is below the item's k-th score so far; that score is carried from block to block.
3. A task returns k rows per item at most; the best k of all tasks are the result. Texts are never shuffled.

NULL and empty texts, and texts without a term, score nothing and count nowhere. Rows without doc_id are documents like
any other and come last among equal scores; repeated rows are documents each. Items without id are left out, rows that repeat an
item id are one item of all their terms, and items without a term that occurs have no rows. Other columns are not read.
Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored, table, texts
from .decontaminate import FOLD

TOP = 10
SLICE_BYTES = 256_000
#: Cells of a block's table, and documents of a block at most.
CELLS, ROWS = 1 << 24, 4096
NO_ID = np.iinfo(np.int64).max
INDEX = "kind byte, doc_id long, n long, terms array<int>, counts array<long>"


def terms_of(text: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded piece at a time."""
    folded, start = text.translate(FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + size)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def item_slices(items: DataFrame, item: str, text: str, slice_bytes: int) -> Iterator[list[tuple]]:
    """Lists of (id, terms); rows of one id are in the same slice."""
    rows = items.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).where("item IS NOT NULL AND text <> ''")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // slice_bytes)
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(count or 1)))
    for k in range(count):
        found: dict = {}
        for row in dealt.where(F.col("slice") == k).toLocalIterator():
            for part in terms_of(row["text"].encode()):
                found.setdefault(row["item"], set()).update(part)
        found = {i: sorted(ts) for i, ts in found.items() if ts}
        if found:
            yield sorted(found.items(), key=lambda pair: str(pair[0]))


def frequencies(docs: DataFrame, vocabulary: dict[bytes, int], text: str) -> DataFrame:
    """Rows of kind 0: a document with a term, its length, its terms of the vocabulary and how often it holds them.
    Rows of kind 1: one per task, documents by term; ``doc_id`` is their number and ``n`` the sum of their lengths."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def batch_of(kind, ids, lengths, found):
        offsets = np.cumsum([0, *(len(f[0]) for f in found)])
        lists = lambda k, t: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([f[k] for f in found]), t))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int8)), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                                           lists(0, pa.int32()), lists(1, pa.int64())], names=["kind", "doc_id", "n", "terms", "counts"])

    def count(batches):
        number = shared.value.get
        held, documents, total = np.zeros(len(shared.value), np.int64), 0, 0
        for batch in slices(batches, "text"):
            ids, lengths, found = [], [], []
            for doc, t in zip(batch.column("doc_id").to_pylist(), texts(batch, "text"), strict=True):
                counted: Counter = Counter()
                length = 0
                for part in terms_of(t):
                    length += len(part)
                    counted.update(map(number, part))
                if not length:
                    continue
                counted.pop(None, None)
                mine = np.fromiter(counted.keys(), np.int32, len(counted))
                order = np.argsort(mine)
                held[mine] += 1
                documents, total = documents + 1, total + length
                ids.append(doc)
                lengths.append(length)
                found.append((mine[order], np.fromiter(counted.values(), np.int64, len(counted))[order]))
            if ids:
                yield batch_of(0, ids, lengths, found)
        here = np.flatnonzero(held)
        yield batch_of(1, [documents], [total], [(here.astype(np.int32), held[here])])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text <> ''")
    return slim.mapInArrow(count, INDEX)


def discounts(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents by their lengths; exact also where the product leaves 64 bits."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 63:
        return 10 + (90 * n * documents) // total
    return np.array([10 + 90 * int(x) * documents // total for x in n], dtype=np.int64)


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // np.maximum(1000 * tf + 8 * m, 1)


class Best:
    """The k highest scores of an item so far; equal scores by ascending id."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> int:
        """No lower score can still enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.floor
        score, ids = np.concatenate([self.score, score[good]]), np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -score))[:self.k]
        self.score, self.ids = score[order], ids[order]


def masks(present: np.ndarray) -> np.ndarray:
    """Presence bits [term, document] packed to rows [document, 64-bit word]."""
    packed = np.packbits(present, axis=0, bitorder="little").T
    wide = np.zeros((packed.shape[0], -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, :packed.shape[1]] = packed
    return wide.view(np.uint64)


def grouped(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct masks, the documents ordered by mask, and the starts of the groups."""
    order = np.lexsort(mask.T[::-1])
    ordered = mask[order]
    starts = np.flatnonzero(np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1)))
    return ordered[starts], order, np.append(starts, len(order))


def evaluate(best: Best, tf: np.ndarray, weight: np.ndarray, m: np.ndarray, ids: np.ndarray) -> int:
    """Bring the scores of a block's documents for one item into ``best``; ``tf``: [term, document]. Returns how many were scored."""
    present = tf > 0
    some = np.flatnonzero(present.any(axis=1))
    if not len(some):
        return 0
    present, tf, weight = present[some], tf[some], weight[some]
    largest = weight * gains(tf.max(axis=1), m.min())
    if int(largest.sum()) < best.floor:
        return 0
    distinct, order, starts = grouped(masks(present))
    bits = np.unpackbits(distinct.view(np.uint8), axis=1, bitorder="little")[:, :len(some)]
    bound = bits.astype(np.int64) @ largest
    queue = np.argsort(-bound, kind="stable")
    scored, at, step = 0, 0, 16
    while at < len(queue) and bound[queue[at]] >= best.floor:
        take = queue[at:at + step]
        take = take[bound[take] >= best.floor]
        who = np.concatenate([order[starts[g]:starts[g + 1]] for g in take.tolist()])
        score = (weight[:, None] * gains(tf[:, who], m[who])).sum(axis=0)
        best.add(score, ids[who])
        scored, at, step = scored + len(who), at + step, step * 2
    return scored


def top_documents(index: DataFrame, items: list[list[int]], weight: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): of every task the k best documents of every item, items by number."""
    shared = index.sparkSession.sparkContext.broadcast(([np.array(i) for i in items], weight))
    rows = max(64, min(ROWS, CELLS // max(1, len(weight))))

    def search(batches):
        wanted, weights = shared.value
        best = [Best(k) for _ in wanted]
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy()
                m = discounts(part.column("n").to_numpy(), documents, total)
                lists = part.column("terms")
                column = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                tf = np.zeros((len(weights), part.num_rows), dtype=np.int64)
                tf[lists.flatten().to_numpy(), column] = part.column("counts").flatten().to_numpy()
                for i, terms in enumerate(wanted):
                    evaluate(best[i], tf[terms], weights[terms], m, ids)
        for i, b in enumerate(best):
            if len(b.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), i, np.int32)), pa.array(b.ids, mask=b.ids == NO_ID), pa.array(b.score)],
                                                 names=["item", "doc_id", "score"])

    return index.where("kind = 0").select("doc_id", "n", "terms", "counts").mapInArrow(search, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", item: str = "item_id", item_text: str = "text",
           slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest scores above 0 of every item."""
    spark, kind = docs.sparkSession, items.schema[item].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()),
                                                  T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    for group in item_slices(items, item, item_text, slice_bytes):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in group for t in ts}))}
        index = stored(frequencies(docs, vocabulary, text), "frequencies")
        tasks = index.where("kind = 1")
        documents, total = tasks.agg(F.coalesce(F.sum("doc_id"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = tasks.select(F.explode(F.arrays_zip("terms", "counts")).alias("e")).groupBy("e.terms").agg(F.sum("e.counts").alias("df")).collect()
        weight = np.zeros(len(vocabulary), dtype=np.int64)
        for row in held:
            weight[row["terms"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * row["df"] + 1)))
        found = top_documents(index, [[vocabulary[t] for t in ts] for _, ts in group], weight, documents, total, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(group)], T.StructType([
            T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        out = out.unionByName(stored(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    return out


def op11_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE item_id IS NOT NULL),
c AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY t, docs),
m AS (SELECT r, doc_id, 10 + (90 * len(ts) * docs) // total AS m FROM d, c WHERE len(ts) > 0),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""
QUERIES = {"op11_mask_search": op11_mask_search}
ORACLES = {"op11_mask_search": ORACLE}
