"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the matrix are documents, columns are hashed n-grams (by default 3 words, A-Z lower-cased); a document with fewer words
is one column, its whole sequence. The product of the matrix with its transpose holds the overlaps; two documents link if their
overlap reaches ``share`` percent of their union. Only entries that can reach it are computed:

1. Equal rows are one class, represented by its smallest id.
2. All columns are put in one order: first by hash, the most frequent ones (at most ``COMMON``, counted over all rows) behind.
   At a similarity of s, a row of a entries shares one of its first a - ceil(s a) + 1 columns with any row it links to, so the product
   runs over these leading columns only, and sizes must agree within s.
3. Every column's rows meet its smallest id, and overlaps are accumulated per pair. With c overlaps among the leading columns, at most
   c and what lies behind them can be common; pairs below the overlap that their sizes demand are discarded. So are pairs whose parity
   sketches (one bit per hashed column, flipped by each entry) differ in more bits than their sizes allow; both bounds lose no link.
   The rest is counted on the full rows, and links join components.
4. Columns that still hold several components are multiplied among all their rows. Those of up to ``SMALL`` rows give pairs of agreeing
   sizes. The rows of a larger column are dealt into blocks of bounded size, every pair of blocks is one group, and the same
   bounds apply inside; a pair is handled in its first common column. First the smallest remaining partner of each
   row is counted, then all pairs that are still between two components.

Columns are 64-bit hashes. NULL texts and texts without words have no entries and are linked with nothing. Rows without id are returned,
linked with nothing; rows that repeat an id must repeat its text and get the same answer each. Columns other than id and text are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table, texts
from .graph import components
from .minhash import BASE, LOWER, Shingler, mix, thinned

WIDTH, SHARE = 3, 90
#: Columns that go to the end of the order: those of at least ``FREQUENT`` rows, and of these the most frequent.
COMMON, FREQUENT = 1 << 17, 16
#: Rows of one block of a column, and pairs compared at once.
BLOCK, PAIRS = 4096, 200_000
#: Columns of up to so many rows are multiplied as a join of pairs.
SMALL = 64
#: Bits of a sketch: the power of two above twice the entries, within these bounds.
SKETCH = (128, 8192)


def leading(n, share: int):
    """How many leading columns a row of n entries is multiplied over."""
    return n - -(-share * n // 100) + 1


def needed(a, b, share: int):
    """The least overlap of linked rows of a and b entries."""
    return -(-share * (a + b) // (100 + share))


class Rows(Shingler):
    """Rows of the matrix: sorted distinct column hashes of each text."""

    def __init__(self, width: int) -> None:
        super().__init__()
        self.width = width

    def sets(self, each: list[bytes]) -> list[np.ndarray]:
        hashes, first = self.word_hashes(each)
        rolling = np.zeros(max(0, len(hashes) - self.width + 1), dtype=np.uint64)
        for j in range(self.width):
            rolling = rolling * BASE + hashes[j:j + len(rolling)]
        rolling = mix(rolling)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= self.width:
                out.append(np.unique(rolling[a:b - self.width + 1]))
            else:
                whole = np.uint64(b - a)
                for h in hashes[a:b]:
                    whole = whole * BASE + h
                out.append(mix(np.array([whole ^ BASE])) if b > a else np.zeros(0, np.uint64))
        return out


def sketch(row: np.ndarray) -> np.ndarray:
    """Parity bits of a row; halves of a wide sketch fold to the narrower one."""
    bits = SKETCH[0]
    while bits < min(SKETCH[1], 2 * len(row)):
        bits *= 2
    flips = np.bincount((mix(row) >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little")


def _listed(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def profiles(docs: DataFrame, width: int, share: int, text: str) -> DataFrame:
    """(doc_id, n, class, head): entries, name of the row as a set, and twice the leading columns by hash."""
    def profile(batches):
        rows = Rows(width)
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text", 2_000_000):
                found = rows.sets([(t or b"").translate(LOWER) for t in texts(batch, "text")])
                names = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() if len(r) else None for r in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(r) for r in found], pa.int64()), pa.array(names, pa.binary()),
                     _listed([r[:2 * leading(len(r), share)] >> np.uint64(2) if len(r) else r for r in found])], names=["doc_id", "n", "class", "head"])

    return docs.mapInArrow(profile, "doc_id long, n long, class binary, head array<long>")


def incidence(docs: DataFrame, common: np.ndarray, width: int, share: int, text: str) -> DataFrame:
    """(id, n, sketch, lead): the leading columns in the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def lead(batches):
        rows = Rows(width)
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text", 2_000_000):
                found = rows.sets([t.translate(LOWER) for t in texts(batch, "text")])
                out, sketches = [], []
                for row in found:
                    column = (row >> np.uint64(2)).astype(np.int64)
                    if len(shared.value):
                        at = np.minimum(np.searchsorted(shared.value, column), len(shared.value) - 1)
                        column = np.sort(column | ((shared.value[at] == column).astype(np.int64) << 62))
                    out.append(column[:leading(len(row), share)] if len(row) else column)
                    sketches.append(sketch(row).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in found], pa.int64()),
                                                  pa.array(sketches, pa.binary()), _listed(out)], names=["id", "n", "sketch", "lead"])

    return docs.mapInArrow(lead, "id long, n long, sketch binary, lead array<long>")


def _sizes(a, b, share: int):
    return 100 * F.least(a, b) >= share * F.greatest(a, b)


def close(a: np.ndarray, b: np.ndarray, n: np.ndarray, sketches: list[bytes], share: int) -> np.ndarray:
    """Of pairs (a, b) of rows, those whose sketches do not rule out a link."""
    widths = np.array([len(s) for s in sketches])
    width = np.minimum(widths[a], widths[b])
    apart = np.zeros(len(a), dtype=np.int64)
    for w in np.unique(width).tolist():
        here = np.flatnonzero(width == w)
        used, where = np.unique(np.concatenate([a[here], b[here]]), return_inverse=True)
        bits = np.zeros((len(used), w // 8), dtype=np.uint64)
        for k, u in enumerate(used.tolist()):
            bits[k] = np.bitwise_xor.reduce(np.frombuffer(sketches[u], dtype=np.uint64).reshape(-1, w // 8), axis=0)
        one, other = where[:len(here)], where[len(here):]
        for part in np.array_split(np.arange(len(here)), max(1, len(here) * w // 16_000_000)):
            apart[here[part]] = np.bitwise_count(bits[one[part]] ^ bits[other[part]]).sum(axis=1)
    total = n[a] + n[b]
    return apart <= total - 2 * needed(n[a], n[b], share)


def _not_far(share: int):
    def keep(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.num_rows
            n = np.concatenate([batch.column("na").to_numpy(), batch.column("nb").to_numpy()])
            sketches = batch.column("sa").to_pylist() + batch.column("sb").to_pylist()
            good = close(np.arange(size), np.arange(size) + size, n, sketches, share)
            yield batch.select(["a", "b"]).filter(pa.array(good))
    return keep


def counted(pairs: DataFrame, docs: DataFrame, width: int, share: int) -> DataFrame:
    """The pairs (a, b) that link on their full rows; ``docs``: (doc_id, text)."""
    def check(batches):
        rows, seen = Rows(width), {}
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text_a", 2_000_000):
                ids, first = batch.column("a").to_pylist(), {}
                for k, i in enumerate(ids):
                    if i not in seen:
                        first.setdefault(i, k)
                left = texts(batch, "text_a")
                made = rows.sets([left[k].translate(LOWER) for k in first.values()])
                seen = {i: seen[i] for i in set(ids) if i in seen} | dict(zip(first, made, strict=True))
                right = rows.sets([t.translate(LOWER) for t in texts(batch, "text_b")])
                overlap = np.array([len(np.intersect1d(seen[i], r, assume_unique=True)) for i, r in zip(ids, right, strict=True)], dtype=np.int64)
                union = np.array([len(seen[i]) + len(r) for i, r in zip(ids, right, strict=True)], dtype=np.int64) - overlap
                yield batch.select(["a", "b"]).filter(pa.array(100 * overlap >= share * union))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    by_id = stored(thinned(docs, ids, "doc_id", "text").select(F.col("doc_id").alias("id"), "text")
                   .join(ids, "id", "left_semi").dropDuplicates(["id"]), "texts")
    left = pairs.join(by_id.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    whole = left.join(by_id.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return stored(whole.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), "links")


def _block_product(share: int):
    """Of the rows of one column (or of two blocks of them): pairs of two components within all bounds, in their first common column."""
    def multiply(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        n, component, block = (group.column(c).to_numpy() for c in ("n", "component", "block"))
        ids, column = group.column("id").to_numpy(), group.column("column")[0].as_py()
        lead = group.column("lead").combine_chunks()
        flat, edges = lead.flatten().to_numpy(), lead.offsets.to_numpy() - lead.offsets[0].as_py()
        mine = lambda k: flat[edges[k]:edges[k + 1]]
        sketches = group.column("sketch").to_pylist()
        across = len(np.unique(block)) > 1
        end = np.searchsorted(n, 100 * n // share, side="right")
        found = []
        start, size = 0, len(n)
        while start < size:  # rows whose partners, further on in the order of size, fit the bound of pairs
            stop = start + max(1, int(np.searchsorted(np.cumsum(end[start:] - np.arange(start, size) - 1), PAIRS, side="right")))
            counts = end[start:stop] - np.arange(start, stop) - 1
            a = np.repeat(np.arange(start, stop), counts)
            b = np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts) + a + 1
            good = component[a] != component[b]
            if across:
                good &= block[a] != block[b]
            a, b = a[good], b[good]
            if len(a):
                good = close(a, b, n, sketches, share)
                a, b = a[good], b[good]
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                common = np.intersect1d(mine(x), mine(y), assume_unique=True)
                if common[0] != column:
                    continue
                behind = n[x] - len(mine(x)) if mine(x)[-1] <= mine(y)[-1] else n[y] - len(mine(y))
                if len(common) + behind >= needed(int(n[x]), int(n[y]), share):
                    found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
            start = stop
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return multiply


def _bounded(pairs: DataFrame, matrix: DataFrame, share: int) -> DataFrame:
    """Of the pairs (a, b), those whose sketches do not rule out a link."""
    for one in ("a", "b"):
        pairs = pairs.join(matrix.select(F.col("id").alias(one), F.col("n").alias(f"n{one}"), F.col("sketch").alias(f"s{one}")), one)
    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_not_far(share), "a long, b long")


def _frequent(rows: DataFrame) -> np.ndarray:
    """Sorted columns of at least ``FREQUENT`` rows; of more than ``COMMON`` such columns those of the most rows."""
    often = stored(rows.groupBy("column").agg(F.count("*").alias("rows")).where(F.col("rows") >= FREQUENT), "frequent")
    steps = often.groupBy(F.floor(4 * F.log2("rows")).alias("step")).agg(F.count("*").alias("columns")).orderBy(F.desc("step")).collect()
    room, least = COMMON, None
    for row in steps:
        room -= row["columns"]
        if room < 0:
            break
        least = row["step"]
    if least is None:
        return np.zeros(0, np.int64)
    return np.sort(often.where(F.floor(4 * F.log2("rows")) >= least).select("column").toPandas()["column"].to_numpy(dtype=np.int64))


def _labels(links: DataFrame) -> DataFrame:
    return stored(components(links).select(F.col("node").alias("id"), "component"), "components")


def linked_classes(docs: DataFrame, width: int = WIDTH, share: int = SHARE, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    told = stored(profiles(slim, width, share, text), "profiles")
    usable = told.where("class IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(usable.groupBy("class").agg(F.min("doc_id").alias("id")), "classes")
    ones = classes.select("id")
    heads = usable.join(ones, usable["doc_id"] == ones["id"], "left_semi").select(F.explode("head").alias("column"))
    matrix = incidence(slim.where("doc_id IS NOT NULL AND text <> ''"), _frequent(heads), width, share, text)
    matrix = stored(matrix.join(ones, "id", "left_semi").dropDuplicates(["id"]), "matrix")

    # Every column's rows meet its smallest id.
    entries = matrix.select("id", "n", F.explode("lead").alias("column"))
    shared = entries.groupBy("column").agg(F.count("*").alias("rows"), F.min(F.struct("id", "n")).alias("first")).where("rows > 1")
    entries = stored(entries.join(shared, "column"), "entries")
    stars = entries.where("id <> first.id").where(_sizes(F.col("n"), F.col("first.n"), share)).groupBy(
        F.col("first.id").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("common"), F.first("first.n").alias("na"), F.first("n").alias("nb"))
    behind = F.ceil(share * F.greatest("na", "nb") / 100) - 1
    stars = stars.where(F.col("common") + behind >= F.ceil(share * (F.col("na") + F.col("nb")) / (100 + share))).select("a", "b")
    tried = stored(_bounded(stars, matrix, share), "pairs")
    label = _labels(counted(tried, slim, width, share))

    # Rows that are still in different components meet each other: in small columns as pairs, in others by blocks.
    rest = entries.where("rows > 2 AND id <> first.id").select("column", "id", "n").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = rest.groupBy("column").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("rows")).where("x <> y")
    rest = stored(rest.join(mixed.select("column", "rows"), "column"), "mixed")
    few = rest.where(F.col("rows") <= SMALL)
    x, y = few.alias("x"), few.alias("y")
    meet = (F.col("x.column") == F.col("y.column")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
    pairs = x.join(y, meet & _sizes(F.col("x.n"), F.col("y.n"), share)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()

    many = rest.where(F.col("rows") > SMALL).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("column", "id", "component", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    blocks = many.join(matrix, "id").groupBy("column", "one", "two").applyInArrow(_block_product(share), "a long, b long")
    more = stored(_bounded(pairs, matrix, share).union(blocks).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")

    once = stored(more.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    label = _labels(label.toDF("a", "b").union(counted(once, slim, width, share)))
    sides = [label.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b")]
    left = more.join(once, ["a", "b"], "left_anti").join(sides[0], "a", "left").join(sides[1], "b", "left").where(
        F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    label = _labels(label.toDF("a", "b").union(counted(stored(left, "pairs"), slim, width, share)))

    named = classes.join(label, "id", "left").select("class", F.coalesce("component", "id").alias("component"))
    out = told.select("doc_id", F.col("n").alias("n_shingles"), "class").join(named, "class", "left")
    own = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_classes(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""
QUERIES = {"op12_ngram_join": op12_ngram_join}
ORACLES = {"op12_ngram_join": ORACLE}
