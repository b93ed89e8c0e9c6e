"""Near-duplicate lines by a segment-partition edit join.

A line is what stands between newlines and holds a word. Equal lines are one class. Two different lines are linked when at most
so many single-character edits apart as the length of the shorter one allows: bands of length have their own number of edits, by
default 1 from 8 characters on and 2 from 20 on. Cut the shorter line into one segment more than its edits, and at least one
segment stands unchanged in the other, near its place. Every line
is indexed by its segments (with its length and the segment's number) and probes, for its own and the lengths just below,
the substrings the shift bounds allow. Lines that meet under a key are candidates, unless the parities of their
bigrams already differ in more places than so few edits can turn; the banded bit-parallel edit distance decides. Connected lines form classes, and every line but a class's first (smallest id,
then position) is dropped.

Lines are named by 64-bit hashes. A key that only one line has is never shuffled a second time; the keys left are
thinned out by a bit map of fixed size. NULL and empty texts have no lines; rows without id are
returned with zeros and take no part; rows that repeat an id share its line positions and get the same answer each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import SPACES, dealt, slices, stored, table, texts
from .graph import components
from .minhash import FILTER_BITS, marks

#: (characters from which, edits) by length.
BANDS = ((8, 1), (20, 2))
#: Lines under a key that one task pairs with the key's others.
KEY_BLOCK = 1024


def allowed(length: int, bands: tuple = BANDS) -> int:
    """Edits that may lie between a line of ``length`` characters and one that is no shorter."""
    return max((edits for least, edits in bands if length >= least), default=0)


def probes(length: int, bands: tuple = BANDS) -> list[tuple[int, int, int, bool]]:
    """(seed, start, end, indexed) of a line of ``length`` characters: its own segments, and the substrings
    that may be segments of a line no longer than this one. The seed stands for that line's length and the segment.
    """
    out = []
    for less in range(allowed(length, bands) + 1):
        own = length - less
        edits = allowed(own, bands)
        if not edits or less > edits:
            continue
        n = edits + 1
        base, short = own // n, n - own % n  # the longer segments stand last
        for i in range(n):
            start, size = base * i + max(0, i - short), base + (i >= short)
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                if 0 <= start + shift and start + shift + size <= length:
                    out.append((own * 64 + i, start + shift, start + shift + size, less == 0 and shift == 0))
    return out


def bag(line: str) -> list[int]:
    """Parities of the line's hashed bigrams, as four words of 64 bits. An edit turns four of them at most."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    spots = (c[:-1] * np.uint32(0x9E3779B1) + c[1:]) * np.uint32(0x85EBCA77) >> np.uint32(24)
    odd = np.bincount(spots, minlength=256).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64).tolist()


def entries(docs: DataFrame, text: str, bands: tuple, shared: DataFrame | None = None) -> DataFrame:
    """(key, id, indexed) of all lines long enough; with ``shared``, of the keys in it and few others, and with bags.

    ``id`` is Spark's ``xxhash64`` of the line. A line counts once per slice of texts.
    """
    bits = docs.sparkSession.sparkContext.broadcast(None if shared is None else marks(shared))

    def cut(batches):
        plans: dict[int, list] = {}
        for batch in slices(batches, text):
            found = {line for t in texts(batch, text) for line in (t or b"").decode().split("\n")}
            keys, ids, indexed, kept = [], [], [], []
            for line in found:
                length = len(line)
                if not allowed(length, bands) or not line.strip(SPACES):
                    continue
                plan = plans.get(length)
                if plan is None:
                    plan = plans[length] = probes(length, bands)
                keys += [xxh64_intdigest(line[a:b], seed) for seed, a, b, _ in plan]
                ids.append((xxh64_intdigest(line, 42), len(plan)))
                indexed += [x for *_, x in plan]
                kept.append(line)
            key = np.array(keys, dtype=np.uint64).view(np.int64)
            one = np.repeat(np.array([i for i, _ in ids], dtype=np.uint64).view(np.int64), np.array([n for _, n in ids], dtype=np.int64))
            own = np.array(indexed, dtype=bool)
            if bits.value is not None:
                spot = key & ((1 << FILTER_BITS) - 1)
                hit = (bits.value[spot >> 6] >> (spot & 63)) & 1 == 1
                owner = np.repeat(np.arange(len(kept)), [n for _, n in ids])[hit]
                need, of = np.unique(owner, return_inverse=True)
                bags = np.array([bag(kept[i]) for i in need.tolist()], dtype=np.int64).reshape(-1, 4)[of]
                columns = [pa.array(x) for x in (key[hit], one[hit], own[hit], *bags.T)]
            else:
                columns = [pa.array(x) for x in (key, one, own)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["key", "id", "indexed"] + ([] if shared is None else [f"bag{i}" for i in range(4)])
    schema = ", ".join(f"{n} {'boolean' if n == 'indexed' else 'long'}" for n in names)
    return docs.where(F.col("doc_id").isNotNull()).select(text).mapInArrow(cut, schema)


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance, or ``most`` + 1 if it is larger; one machine word per column of a diagonal band."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    lead = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    a, b = a[lead:], b[lead:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), len(b))
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not b:
        return min(len(a), most + 1)
    # Bit r of the band stands for row j - most + r of column j; rows are positions of the longer text.
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    width = 2 * most + 2
    full = (1 << width) - 1
    top = 1 << width - 1
    # The distance is followed down the lowest diagonal, then along the last row (from the start if it is near).
    plus, minus, distance = full ^ ((1 << width - 1 - most) - 1), 0, min(most, len(a))
    across = top >> 1 + max(0, most - len(a))
    for j, c in enumerate(b):
        low = j + most + 1 - width
        match = where.get(c, 0)
        match = (match >> low if low >= 0 else match << -low) & full
        diagonal = ((((match & plus) + plus) ^ plus) | match | minus) & full
        right_up = (minus | ~(diagonal | plus)) & full
        right_down = diagonal & plus
        if j < len(a) - most:
            distance += not diagonal & top
        else:
            distance += bool(right_up & across) - bool(right_down & across)
            across >>= 1
        plus = (right_down | ~((diagonal >> 1) | right_up)) & full
        minus = (diagonal >> 1) & right_up
        if distance > 2 * most:
            return most + 1
    return min(distance, most + 1)


def thin(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose ``column`` may be among the one column of ``values``; no shuffle, nothing that is among them is lost."""
    shared = rows.sparkSession.sparkContext.broadcast(marks(values))

    def keep(batches):
        for batch in batches:
            s = batch.column(column).to_numpy(zero_copy_only=False) & ((1 << FILTER_BITS) - 1)
            hit = (shared.value[s >> 6] >> (s & 63)) & 1 == 1
            if hit.any():
                yield batch.filter(pa.array(hit))

    return rows.mapInArrow(keep, rows.schema)


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, position, line, id) of every line with a word."""
    split = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.posexplode(F.split(text, "\n")).alias("position", "line"))
    return split.where(F.btrim("line", F.lit(SPACES)) != "").withColumn("id", F.xxhash64("line"))


def links(docs: DataFrame, text: str = "text", bands: tuple = BANDS) -> DataFrame:
    """Pairs (a, b) of ids of different lines as near as ``bands`` allow."""
    edits = max((e for _, e in bands), default=0)
    lines = lines_of(docs, text)
    every = entries(docs, text, bands)
    shared = stored(every.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("key"), "line-keys")
    some = entries(docs, text, bands, shared).join(shared, "key").distinct()
    some = stored(some, "line-entries")
    turned = sum((F.bit_count(F.col(f"i.bag{k}").bitwiseXOR(F.col(f"p.bag{k}"))) for k in range(4)), F.lit(0))
    every, one = dealt(some, block=KEY_BLOCK)
    met = every.where("indexed").alias("i").join(one.alias("p"), (F.col("i.key") == F.col("p.key")) & (F.col("i.block") == F.col("p.block"))).where(
        (F.col("i.id") != F.col("p.id")) & (~F.col("p.indexed") | (F.col("i.id") < F.col("p.id"))) & (turned <= 4 * edits))
    pairs = stored(met.select(F.least("i.id", "p.id").alias("a"), F.greatest("i.id", "p.id").alias("b")).distinct(), "line-pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    known = thin(lines.select("id", "line"), "id", ids).join(ids, "id", "left_semi").dropDuplicates(["id"])
    known = stored(known, "line-texts")

    def check(batches):
        for batch in batches:
            near = [edit_distance(x, y, k) <= k for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
                    for k in (allowed(min(len(x), len(y)), bands),)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(known.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
    both = both.join(known.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def deduplicate(docs: DataFrame, text: str = "text", bands: tuple = BANDS) -> DataFrame:
    """Per document: n_lines, n_links (links of its lines to different lines), n_dropped, the positions dropped and the lines' classes.

    ``line_classes`` has (position, class_doc_id, class_position, links) of every line by position: a class is named by
    the id and position of its first line, and ``links`` counts the different lines that this one is linked to.
    """
    lines = lines_of(docs, text)
    pairs = stored(links(docs, text, bands), "line-links")
    degree = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("links"))
    classes = components(pairs).join(degree.withColumnRenamed("id", "node"), "node", "left").select(F.col("node").alias("id"), "component", "links")
    told = stored(lines.select("doc_id", "position", "id").join(classes, "id", "left").select(
        "doc_id", "position", F.coalesce("component", "id").alias("class"), F.coalesce("links", F.lit(0)).alias("links")), "line-classes")
    first = told.groupBy("class").agg(F.min(F.struct("doc_id", "position")).alias("first"), F.count("*").alias("n")).where("n > 1")
    own = F.struct("doc_id", "position")
    marked = told.join(first.select("class", "first"), "class", "left").withColumn("first", F.coalesce("first", own)).withColumn("dropped", own != F.col("first"))
    named = F.struct("position", F.col("first.doc_id").alias("class_doc_id"), F.col("first.position").alias("class_position"), "links")
    by_doc = marked.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum("links").alias("n_links"), F.count_if("dropped").alias("n_dropped"),
        F.array_sort(F.collect_list(F.when(F.col("dropped"), F.col("position")))).alias("dropped_lines"),
        F.array_sort(F.collect_set(named)).alias("line_classes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.select("doc_id").join(by_doc, "doc_id", "left").select(
        "doc_id", zero("n_lines"), zero("n_links"), zero("n_dropped"), F.coalesce("dropped_lines", F.array().cast("array<int>")).alias("dropped_lines"),
        F.coalesce("line_classes", F.array().cast(by_doc.schema["line_classes"].dataType)).alias("line_classes"))


def op7_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


QUERIES = {"op7_line_edit_join": op7_line_edit_join}
ORACLES: dict[str, str] = {}
