"""Near-duplicates by b-bit MinHash.

Words are runs of non-blanks with A-Z lower-cased; a document's set holds its distinct 5-word shingles, or
its whole word sequence if that is shorter. Documents are linked when the Jaccard similarity of their sets reaches 0.75.

1. One pass over the texts makes 128 minima per document. Rows of four make 32 band keys; the low two
   bits of every minimum are packed into two bit planes of 128 bits, which is all that is kept.
2. Equal word sequences are one class; only its smallest id goes on.
3. Candidates share a band key. At similarity 0.75 a pair misses all bands with probability 5e-6.
   First every member of a bucket is paired with the bucket's smallest; links join components. Then members
   of one bucket that are still in different components are paired, in the first band they share. So a group
   of many near copies costs links in proportion to its size, and no pair that could join two components is left out.
4. A candidate goes on if the similarity estimated from the bit planes, corrected for accidental
   agreement of low bits, is within five standard errors of the threshold or above. Of the second kind of pairs there
   may be many just below the threshold, so these need a second estimate from 1024 minima.
5. Links are confirmed on the full sets of words. Components are the classes of the result.

Texts that are NULL or have no word have an empty set and are linked with nothing. Rows without id are returned,
linked with nothing. Rows that repeat an id and text share a component. Input columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, dealt, slices, stored, table, texts, unboxed
from .graph import components

SHINGLE = 5
MINIMA, ROWS, BITS = 128, 4, 2
NUMERATOR, DENOMINATOR = 75, 100
FINE = 1024
#: Estimated similarity from which a candidate goes on, by minima: the threshold less five standard errors.
ESTIMATE = {MINIMA: 0.52, FINE: 0.66}
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SIGNATURE = "doc_id long, n_shingles long, class binary, low array<long>, high array<long>, bands array<long>"
#: Members of a bucket that one task pairs with the bucket's others.
KEY_BLOCK = 1024
#: Bits of the filter that thins out texts before they are shuffled; its size does not grow with the data.
FILTER_BITS = 24

_SEED = np.random.default_rng(20240501)
MULTIPLIERS = _SEED.integers(1, 1 << 63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _SEED.integers(0, 1 << 63, FINE, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of the distinct shingles of texts, computed over a whole slice at once."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(0, np.uint64)
        self.blank = np.zeros(256, dtype=bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True

    def word_hashes(self, each: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and of every text the index of its first word (one more at the end)."""
        joined = np.frombuffer(b"\n" + b"\n".join(each) + b"\n", dtype=np.uint8)
        if len(self.powers) < len(joined):
            for name, base in (("powers", int(BASE)), ("inverses", pow(int(BASE), -1, 1 << 64))):
                p = np.full(len(joined) + 1, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        blank = self.blank[joined]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(joined) + 1, dtype=np.uint64)
        np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * self.powers[:len(joined)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.inverses[starts])
        offsets = np.cumsum([1, *(len(t) + 1 for t in each)])
        return hashes, np.searchsorted(starts, offsets)

    def sets(self, each: list[bytes]) -> list[np.ndarray]:
        hashes, first = self.word_hashes(each)
        rolling = np.zeros(max(0, len(hashes) - SHINGLE + 1), dtype=np.uint64)
        for j in range(SHINGLE):
            rolling = rolling * BASE + hashes[j:j + len(rolling)]
        rolling = mix(rolling)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(rolling[a:b - SHINGLE + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for h in hashes[a:b]:
                    short = short * BASE + h
                out.append(mix(np.array([short ^ BASE])))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def minima(shingles: np.ndarray, count: int = MINIMA, block: int = 1 << 16) -> np.ndarray:
    """The minimum of each of ``count`` hash functions, a block of products at a time."""
    out = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    multipliers, offsets = MULTIPLIERS[:count, None], OFFSETS[:count, None]
    for i in range(0, len(shingles), block // count):
        np.minimum(out, (shingles[i:i + block // count] * multipliers + offsets).min(axis=1), out=out)
    return out


def planes(least: np.ndarray) -> list[np.ndarray]:
    """Low bits of the minima [text, function], one packed plane per bit."""
    bits = mix(least) >> np.uint64(64 - BITS)
    return [np.packbits((bits >> np.uint64(k)) & np.uint64(1) == 1, axis=1, bitorder="little").view(np.int64) for k in range(BITS)]


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), pa.int64()))


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: set size, class of equal word sequences, bit planes and band keys."""
    def sign(batches):
        shingler = Shingler()
        band = np.multiply.accumulate(np.full(ROWS, BASE, dtype=np.uint64))
        number = np.arange(MINIMA // ROWS, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for batch in slices(batches, text, 2_000_000):
                each = [(t or b"").translate(LOWER) for t in texts(batch, text)]
                found = shingler.sets(each)
                least = np.array([minima(s) for s in found], dtype=np.uint64).reshape(-1, MINIMA)
                keys = mix((least.reshape(len(found), -1, ROWS) * band).sum(axis=2, dtype=np.uint64) + number)
                has = np.array([len(s) > 0 for s in found])
                each_class = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() if h else None for t, h in zip(each, has, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array(each_class, pa.binary()),
                     *[lists(p) for p in planes(least)], lists(keys.view(np.int64))],
                    names=["doc_id", "n_shingles", "class", "low", "high", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(sign, SIGNATURE)


def fine_planes(by_id: DataFrame) -> DataFrame:
    """(id, fine_low, fine_high): bit planes of ``FINE`` minima."""
    def sign(batches):
        shingler = Shingler()
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text", 2_000_000):
                found = shingler.sets([t.translate(LOWER) for t in texts(batch, "text")])
                both = planes(np.array([minima(s, FINE) for s in found], dtype=np.uint64).reshape(-1, FINE))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *map(lists, both)], names=["id", "fine_low", "fine_high"])

    return by_id.mapInArrow(sign, "id long, fine_low array<long>, fine_high array<long>")


def estimate(one: str, other: str, count: int = MINIMA, prefix: str = "") -> Column:
    """Similarity from the share of agreeing low bits, less the share that agrees by accident."""
    unlike = lambda plane, k: F.col(f"{one}.{prefix}{plane}")[k].bitwiseXOR(F.col(f"{other}.{prefix}{plane}")[k])
    differ = sum((F.bit_count(unlike("low", k).bitwiseOR(unlike("high", k))) for k in range(count // 64)), F.lit(0))
    return (1 - differ / float(count) - 2.0**-BITS) / (1 - 2.0**-BITS)


def _plausible(one: str, other: str) -> Column:
    a, b = F.col(f"{one}.n_shingles"), F.col(f"{other}.n_shingles")
    return (DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b)) & (estimate(one, other) >= ESTIMATE[MINIMA])


def marks(hashes: DataFrame) -> np.ndarray:
    """Bit map of the low FILTER_BITS bits of one column of hashes: 2 MiB, gathered as 2^18 rows at most."""
    spot = F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    marked = hashes.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toPandas()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bitmap[marked["w"].to_numpy(dtype=np.int64)] = marked["bits"].to_numpy(dtype=np.int64)
    return bitmap


def thinned(docs: DataFrame, ids: DataFrame, column: str, text: str) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``, and few others, without a shuffle.

    A bit map of hashed ids goes to the tasks; a hit may be accidental, a miss is certain.
    """
    shared = docs.sparkSession.sparkContext.broadcast(marks(ids.select(F.xxhash64(ids.columns[0]))))

    def keep(batches):
        for batch in batches:
            s = batch.column("_spot").to_numpy(zero_copy_only=False) & ((1 << FILTER_BITS) - 1)
            hit = (shared.value[s >> 6] >> (s & 63)) & 1 == 1
            if hit.any():
                yield batch.drop_columns(["_spot"]).filter(pa.array(hit))

    slim = docs.select(F.col(column).cast("long").alias(column), F.col(text).cast("string").alias(text)).where(F.col(column).isNotNull())
    return slim.withColumn("_spot", F.xxhash64(column)).mapInArrow(keep, slim.schema)


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose id is in ``ids``; only rows that a bit map of the ids points to are shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(marks(ids.select(F.xxhash64(ids.columns[0]))))

    def pick(wanted: bool):
        def keep(batches):
            for batch in batches:
                s = batch.column("_spot").to_numpy(zero_copy_only=False) & ((1 << FILTER_BITS) - 1)
                hit = ((shared.value[s >> 6] >> (s & 63)) & 1 == 1) == wanted
                if hit.any():
                    yield batch.drop_columns(["_spot"]).filter(pa.array(hit))
        return box.withColumn("_spot", F.xxhash64(F.col(column).cast("long"))).mapInArrow(keep, box.schema)

    box = boxed(docs, column)
    gone = ids.select(F.col(ids.columns[0]).alias("_gone"))
    suspects = pick(True)
    left = pick(False).union(suspects.join(gone, suspects[column] == gone["_gone"], "left_anti"))
    return unboxed(left, docs.columns, column)


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one document of every group of near-duplicates, the smallest id; same columns."""
    return without(docs, near_duplicates(docs, text).where("not kept").select("doc_id"))


def confirmed(pairs: DataFrame, by_id: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; ``by_id``: (id, text)."""
    def shingles(t: bytes) -> set:
        ws = t.translate(LOWER).split()
        return {tuple(ws[i:i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))}

    def check(batches):
        seen: dict[int, set] = {}  # sets of the last slice: a bucket's smallest member recurs
        for batch in slices(batches, "text_a", 2_000_000):
            keep, last = [], seen
            seen = {}
            for a, ta, tb in zip(batch.column("a").to_pylist(), texts(batch, "text_a"), texts(batch, "text_b"), strict=True):
                sa = seen[a] = seen.get(a) or last.get(a) or shingles(ta)
                sb = shingles(tb)
                common = len(sa & sb)
                keep.append(DENOMINATOR * common >= NUMERATOR * (len(sa) + len(sb) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(by_id.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    whole = left.join(by_id.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return whole.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document."""
    slim = docs.select("doc_id", text)
    signed = stored(signatures(slim, text), "signatures")
    usable = signed.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(usable.groupBy("class").agg(F.min("doc_id").alias("id")), "classes")
    ones = usable.join(classes, [usable["class"] == classes["class"], usable["doc_id"] == classes["id"]], "left_semi")
    ones = ones.select(F.col("doc_id").alias("id"), "n_shingles", "low", "high", "bands")

    rows = ones.select("id", F.posexplode("bands").alias("band", "key")).distinct()
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    rows = stored(rows.join(shared, "key").select("key", "band", "id", "first"), "buckets")
    ids = rows.select("id").distinct()
    sign = stored(ones.join(ids, "id", "left_semi").dropDuplicates(["id"]), "planes")
    by_id = stored(thinned(slim, ids, "doc_id", text).select(F.col("doc_id").alias("id"), F.col(text).alias("text"))
                   .join(ids, "id", "left_semi").dropDuplicates(["id"]), "texts")

    stars = rows.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    pair = lambda p: (p.join(sign.alias("x"), F.col("a") == F.col("x.id")).join(sign.alias("y"), F.col("b") == F.col("y.id"))
                      .where(_plausible("x", "y")).select("a", "b"))
    tried = stored(pair(stars), "pairs")
    first = components(confirmed(tried, by_id))
    first = stored(ids.join(first.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "components")

    # Buckets whose members are not yet together.
    labelled = rows.select("key", "band", "id").join(first, "id")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    mixed = stored(labelled.join(mixed, "key"), "mixed")
    fine = fine_planes(by_id.join(mixed.select("id").distinct(), "id", "left_semi"))
    left = stored(mixed.join(stored(sign.join(fine, "id"), "fine"), "id"), "mixed")
    every, one = dealt(left, block=KEY_BLOCK)
    x, y = every.alias("x"), one.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
    close = estimate("x", "y", FINE, "fine_") >= ESTIMATE[FINE]
    agree = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True)
    more = x.join(y, apart & _plausible("x", "y") & close & (agree == F.col("x.band") + 1)).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.component").alias("ca"), F.col("y.component").alias("cb"))
    more = stored(more.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    joined = stored(confirmed(more.select("a", "b"), by_id), "links").join(more, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    second = components(joined).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    final = first.join(second, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))

    told = classes.join(final, "id", "left").select("class", F.coalesce("component", "id").alias("component"))
    out = signed.select("doc_id", "n_shingles", "class").join(told, "class", "left")
    alone = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, w.doc_id = min(r.b) AS kept
FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""
QUERIES = {"op2_minhash": op2_minhash}
ORACLES = {"op2_minhash": ORACLE}
