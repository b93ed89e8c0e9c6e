"""Exact substring deduplication with a compressed FM-index per shard.

A window is ``WINDOW`` consecutive words of one document. Every word covered by a window whose word sequence
also starts earlier (smaller id, or earlier in the same document) is removed; windows are judged on the input.

Equal windows have to meet in one shard whatever the corpus size, so shards hold content and not
documents. One pass picks the smallest 5-word hash of every window as its seed; a run of windows
around one seed is a context (20 to 35 words), and equal windows lie at the same place beside equal seeds.

* Seeds that occur once in the corpus end here: a first pass counts seeds alone, and a second one
  drops them with a bit map of fixed size before anything else is shuffled.
* Equal contexts are one entry, the first occurrence; all later occurrences are repeats as a whole. The
  minimum is pre-aggregated, so a passage in a third of all documents costs one row per task.
* Seeds with different contexts go to shards by hash. A shard builds one FM-index (wavelet
  matrix) over its contexts, streams their windows through it by backward search, and the windows of one interval are
  equal: the earliest stays, the others are reported as intervals.
* A seed with more than ``WIDE`` contexts would overfill a shard; its windows are dealt out by their
  own content instead, which leaves equal windows only, and their minimum decides.

Words are compared by two 64-bit hashes of contexts or 20 of words. NULL texts have no words. Rows
without id keep everything and remove nothing. Rows that repeat an id must repeat its text; they count as one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table, texts
from .fmindex import FMIndex
from .minhash import BASE, FILTER_BITS, Shingler, marks, mix, thinned

WINDOW, SEED = 20, 5
SHARD_WORDS = 400_000
WIDE = 200
STREAM = 1 << 17
CONTEXT = "doc_id long, seed long, context long, start int, stop int"


class _Powers:
    """Powers of the base and its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
                p = np.full(n, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))


def _leftmost(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of every ``width`` neighbours."""
    def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] <= values[b], a, b)

    at, step = np.arange(len(values)), 1
    while 2 * step <= width:
        at, step = less(at[:-step], at[step:]), 2 * step
    return less(at[:len(at) - (width - step)], at[width - step:])


def contexts(hashes: np.ndarray, first: np.ndarray, powers: _Powers):
    """(text, seed, context, start, stop) arrays: runs of windows (first and last start, within the text) around one seed."""
    n = len(hashes)
    if n < WINDOW:
        return [np.zeros(0, np.int64)] * 5
    powers.need(n + 1)
    rolling = np.zeros(n - SEED + 1, dtype=np.uint64)
    for j in range(SEED):
        rolling = rolling * BASE + hashes[j:j + len(rolling)]
    rolling = mix(rolling)
    at = _leftmost(rolling, WINDOW - SEED + 1)
    text = np.searchsorted(first, np.arange(n), side="right") - 1
    valid = text[:n - WINDOW + 1] == text[WINDOW - 1:]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return [np.zeros(0, np.int64)] * 5
    seeds, own = at[starts], text[starts]
    new = np.concatenate(([True], (seeds[1:] != seeds[:-1]) | (own[1:] != own[:-1])))
    begin = np.flatnonzero(new)
    a, b = starts[begin], starts[np.concatenate((begin[1:], [len(starts)])) - 1]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers.up[:n], dtype=np.uint64)))
    whole = mix(((sums[b + WINDOW] - sums[a]) * powers.down[a]) ^ (b - a).astype(np.uint64))
    base = first[own[begin]]
    return own[begin], rolling[seeds[begin]].view(np.int64), whole.view(np.int64), a - base, b - base


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, sha) of all words."""
    def digest(batches):
        for batch in slices(batches, text):
            each = [(t or b"").split() for t in texts(batch, text)]
            sha = [hashlib.sha256(b" ".join(ws)).hexdigest() for ws in each]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(ws) for ws in each], pa.int64()), pa.array(sha)],
                                             names=["doc_id", "n_words", "sha"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(digest, "doc_id long, n_words long, sha string")


def _slice_contexts(batches, text: str):
    """(batch, owner, seed, context, start, stop) of every slice of texts."""
    shingler, powers = Shingler(), _Powers()
    with np.errstate(over="ignore"):
        for batch in slices(batches, text, 2_000_000):
            hashes, first = shingler.word_hashes([t or b"" for t in texts(batch, text)])
            yield batch, *contexts(hashes, first[:-1], powers)


def repeated_seeds(docs: DataFrame, text: str = "text") -> DataFrame:
    """Seeds that occur twice or more."""
    def count(batches):
        for _, _, seed, *_ in _slice_contexts(batches, text):
            each, n = np.unique(seed, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.int64()), pa.array(n, pa.int64())], names=["seed", "n"])

    return docs.select(text).mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed")


def occurrences(docs: DataFrame, repeated: DataFrame, text: str = "text") -> DataFrame:
    """Contexts of the repeated seeds, and of few others."""
    shared = docs.sparkSession.sparkContext.broadcast(marks(repeated))

    def find(batches):
        for batch, owner, *columns in _slice_contexts(batches, text):
            spot = columns[0] & ((1 << FILTER_BITS) - 1)
            hit = (shared.value[spot >> 6] >> (spot & 63)) & 1 == 1
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[owner[hit]]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64())] + [
                pa.array(c[hit], t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)],
                names=["doc_id", "seed", "context", "start", "stop"])

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(find, CONTEXT)


def segments(wanted: DataFrame, shards: int) -> DataFrame:
    """(shard, doc_id, start, words): the word hashes of contexts listed in ``todo`` (start, stop, seed)."""
    def cut(batches):
        shingler = Shingler()
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text", 1_000_000):
                hashes, first = shingler.word_hashes([t or b"" for t in texts(batch, "text")])
                out = [(c["seed"] % shards, doc, c["start"], hashes[base + c["start"]:base + c["stop"] + WINDOW].tobytes())
                       for doc, base, todo in zip(batch.column("doc_id").to_pylist(), first.tolist(), batch.column("todo").to_pylist(), strict=False)
                       for c in todo]
                types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                                 names=["shard", "doc_id", "start", "words"])

    return wanted.mapInArrow(cut, "shard long, doc_id long, start int, words binary")


def windows(wanted: DataFrame) -> DataFrame:
    """(seed, window, doc_id, start): every window of the contexts listed in ``todo`` by its own hash."""
    def cut(batches):
        shingler = Shingler()
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text", 1_000_000):
                hashes, first = shingler.word_hashes([t or b"" for t in texts(batch, "text")])
                whole = np.zeros(max(0, len(hashes) - WINDOW + 1), dtype=np.uint64)
                for j in range(WINDOW):
                    whole = whole * BASE + hashes[j:j + len(whole)]
                whole = mix(whole).view(np.int64)
                out = [(c["seed"], whole[base + i], doc, i)
                       for doc, base, todo in zip(batch.column("doc_id").to_pylist(), first.tolist(), batch.column("todo").to_pylist(), strict=False)
                       for c in todo for i in range(c["start"], c["stop"] + 1)]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                                 names=["seed", "window", "doc_id", "start"])

    return wanted.mapInArrow(cut, "seed long, window long, doc_id long, start int")


def search_shard(shard: pa.Table) -> pa.Table:
    """Index the shard's segments and report, per segment, the intervals of repeated windows."""
    shard = shard.sort_by([("doc_id", "ascending"), ("start", "ascending")])
    words = [np.frombuffer(w, dtype=np.uint64) for w in shard.column("words").to_pylist()]
    sizes = np.array([len(w) + 1 for w in words])
    place = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), dtype=np.int64)  # 0 ends a segment
    inside = np.ones(len(text), dtype=bool)
    inside[place + sizes - 1] = False
    text[inside] = np.unique(np.concatenate(words), return_inverse=True)[1] + 1
    index = FMIndex(text, WINDOW)
    windows = sizes - WINDOW
    owner = np.repeat(np.arange(len(words)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = place[owner] + offset
    found = []
    for i in range(0, len(starts), STREAM):
        at, low = index.repeats(text, starts[i:i + STREAM], WINDOW)
        found.append((at + i, low))
    at, low = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(low, kind="stable")  # windows stand in the order of (document, start)
    later = np.zeros(len(starts), dtype=bool)
    ordered = low[order]
    later[at[order[1:][ordered[1:] == ordered[:-1]]]] = True
    hit = np.flatnonzero(later)
    doc, first = shard.column("doc_id").to_numpy(), shard.column("start").to_numpy()
    new = np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0)))[:len(hit)]
    a = hit[new]
    b = hit[np.concatenate((np.flatnonzero(new)[1:], [len(hit)])) - 1] if len(hit) else hit
    return pa.table({"doc_id": pa.array(doc[owner[a]], pa.int64()), "start": pa.array(first[owner[a]] + offset[a], pa.int64()),
                     "stop": pa.array(first[owner[b]] + offset[b] + WINDOW, pa.int64())})


def repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, start, stop): word ranges covered by windows that also start earlier."""
    rows = occurrences(docs, stored(repeated_seeds(docs, text), "repeated-seeds"), text)
    entries = rows.groupBy("seed", "context").agg(F.min(F.struct("doc_id", "start", "stop")).alias("at"), F.count("*").alias("n"))
    by_seed = entries.groupBy("seed").agg(F.count("*").alias("contexts"), F.sum("n").alias("all")).where("all > 1")
    entries = stored(entries.join(by_seed.select("seed", "contexts"), "seed"), "contexts")

    again = entries.where("n > 1").select("seed", "context", "at")
    later = rows.join(again, ["seed", "context"]).where(F.struct("doc_id", "start", "stop") != F.col("at")).select(
        "doc_id", F.col("start").cast("long"), (F.col("stop") + WINDOW).cast("long").alias("stop"))

    todo = entries.where("contexts > 1").select("seed", "at.*", (F.col("contexts") > WIDE).alias("wide"))
    size, wide = todo.agg(F.sum(F.when(~F.col("wide"), F.col("stop") - F.col("start") + WINDOW)), F.count_if("wide")).first()

    def wanted(part: DataFrame) -> DataFrame:
        lists = part.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "seed"))).alias("todo"))
        some = thinned(docs, part.select("doc_id").distinct(), "doc_id", text).withColumnRenamed(text, "text")
        return some.join(lists, "doc_id").dropDuplicates(["doc_id"])

    shards = max(1, -(-(size or 0) // SHARD_WORDS))
    found = segments(wanted(todo.where("not wide")), shards).groupBy("shard").applyInArrow(search_shard, "doc_id long, start long, stop long")
    if not wide:
        return later.union(found)
    single = windows(wanted(todo.where("wide")))
    firsts = single.groupBy("seed", "window").agg(F.min(F.struct("doc_id", "start")).alias("at"), F.count("*").alias("n")).where("n > 1")
    apart = single.join(firsts.drop("n"), ["seed", "window"]).where(F.struct("doc_id", "start") != F.col("at")).select(
        "doc_id", F.col("start").cast("long"), (F.col("start") + WINDOW).cast("long").alias("stop"))
    return later.union(found).union(apart)


def _kept(words: list[bytes], ranges: list[dict]) -> list[bytes]:
    out, at = [], 0
    for r in ranges:
        out += words[at:r["start"]]
        at = max(at, r["stop"])
    return out + words[at:]


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, ranges): ``ranges`` are the removed word ranges, in order; they may overlap."""
    base = stored(digests(docs, text), "digests")
    ranges = repeats(docs, text).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("ranges"))
    ranges = stored(ranges, "ranges")
    some = thinned(docs, ranges.select("doc_id"), "doc_id", text).withColumnRenamed(text, "text").join(ranges, "doc_id").dropDuplicates(["doc_id"])

    def digest(batches):
        for batch in slices(batches, "text", 2_000_000):
            left, sha = [], []
            for t, r in zip(texts(batch, "text"), batch.column("ranges").to_pylist(), strict=True):
                kept = _kept((t or b"").split(), r)
                left.append(len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(left, pa.int64()), pa.array(sha), batch.column("ranges")],
                                             names=["doc_id", "n_kept", "kept", "ranges"])

    changed = some.mapInArrow(digest, "doc_id long, n_kept long, kept string, ranges array<struct<start: long, stop: long>>")
    return base.select("doc_id", "n_words", "sha").join(changed, "doc_id", "left").select(
        "doc_id", "n_words", (F.col("n_words") - F.coalesce("n_kept", "n_words")).alias("n_removed"),
        F.coalesce("kept", "sha").alias("kept_sha256"), "ranges")


def op4_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 19), ' ')) AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
p AS (SELECT doc_id, i AS p, ws[i] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
k AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.p) AS t, count(*) AS n FROM p ANTI JOIN c ON c.doc_id = p.doc_id AND c.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
QUERIES = {"op4_fm_substrings": op4_fm_substrings}
ORACLES = {"op4_fm_substrings": ORACLE}
