"""Spelling variants by a frequency-vector trie.

Two words are near if one inserted, deleted or replaced code point apart. A word's vector counts its code points
by letter group (code point modulo 32). The words are arranged in a trie by successive counts: the upper levels count
merged groups, the lower ones single groups. An edit adds at most one letter (surplus) and takes at most one away (deficit),
so a search from a word spends a budget of one each on its way down; the words of the leaves it reaches are verified.

1. The upper levels are spent when the rows are dealt: a word stands under its own path, and probes its own path, the paths with
   one letter less in one merged group, and those with one more in a later group besides. Every near pair meets once: longer
   words look for shorter ones, and of two equally long words the one whose lost group comes first looks for the other.
   The number of upper levels follows from the number of words, so that paths hold few words at any size.
2. Words and probes of one path are dealt into blocks of bounded size, each pair of blocks one group. A group builds the
   trie of its words and walks the lower levels depth-first, a chunk of probes at a time.
3. A group returns per word its near words' number and the best of them, never the pairs.

Of a word's near words the one of largest n (ties: the smallest in code-point order) is its form, if that n is at least ``ratio``
times its own; the root is reached by following forms. NULL and empty texts have no runs; runs of rows without id stay as they are;
repeated rows count each time; columns other than id and text are not read. An empty table has no words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table, texts
from .minhash import LOWER

GROUPS = 32
SHORTEST, LEAST, RATIO, RATE = 7, 2, 10, 31
#: Words and probes of one group at most, and probes that walk down together.
BLOCK, PROBES, CHUNK = 16_384, 65_536, 8_192
#: Words up to this length are compared as rows of a matrix, longer ones one by one.
ROW = 48
FLUSH = 400_000
MULTIPLIERS = np.random.default_rng(13).integers(1, 1 << 63, GROUPS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OWN = 127


def run_counts(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, least: int = LEAST, rate: int = RATE) -> DataFrame:
    """(word, n): letter runs of all texts, one in ``rate`` with a code point deleted by the CRC of ``<doc_id>:<run>``."""
    pattern = re.compile("[A-Za-zÀ-ÿ]{%d,}" % shortest)

    def count(batches):
        total: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
        for batch in slices(batches, "text"):
            for doc, t in zip(texts(batch, "id"), texts(batch, "text"), strict=True):
                if not t:
                    continue
                prefix = None if doc is None else zlib.crc32(doc + b":")
                for run, n in Counter(pattern.findall(t.translate(LOWER).decode())).items():
                    h = 1 if prefix is None else zlib.crc32(run.encode(), prefix)
                    if h % rate == 0:
                        gone = h % len(run)
                        run = run[:gone] + run[gone + 1:]
                        if len(run) < shortest:
                            continue
                    total[run] += n
                if len(total) > FLUSH:
                    yield flush()
                    total.clear()
        if total:
            yield flush()

    slim = docs.select(F.col("doc_id").cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("text <> ''")
    return slim.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def levels(words: int) -> int:
    """Upper levels of the trie: each divides the words of a path by about four."""
    return min(GROUPS, max(2, math.ceil(math.log(max(words, 1) / 4096, 4)) + 1))


def vectors(words: list[str]) -> np.ndarray:
    """Letter-group counts [word, group]."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4") % GROUPS
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(row * GROUPS + codes, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)


def dealt(words: DataFrame, upper: int) -> DataFrame:
    """(path, word, n, less, more): less = -1 where the word stands, else the merged groups its probe gives and takes."""
    groups = np.arange(GROUPS) % upper

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            each = batch.column("word").to_pylist()
            merged = np.stack([vectors(each)[:, groups == j].sum(axis=1) for j in range(upper)], axis=1)
            own = (merged.astype(np.uint64) * MULTIPLIERS[:upper]).sum(axis=1, dtype=np.uint64)
            everyone = np.arange(len(each))
            moves = [(everyone, own, -1, -1), (everyone, own, OWN, OWN)]
            for i in range(upper):
                has = np.flatnonzero(merged[:, i])
                shorter = own[has] - MULTIPLIERS[i]
                moves.append((has, shorter, i, -1))
                moves += [(has, shorter + MULTIPLIERS[j], i, j) for j in range(i + 1, upper)]
            for rows, path, less, more in moves:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(path.view(np.int64)), batch.column("word").take(pa.array(rows)), batch.column("n").take(pa.array(rows)),
                     pa.array(np.full(len(rows), less, np.int8)), pa.array(np.full(len(rows), more, np.int8))],
                    names=["path", "word", "n", "less", "more"])

    return words.select("word", "n").mapInArrow(deal, "path long, word string, n long, less byte, more byte")


class Trie:
    """Distinct vectors of some words by successive counts; a node of level l + 1 is the pair (parent, count)."""

    def __init__(self, counts: np.ndarray) -> None:
        order = np.lexsort(counts.T[::-1])
        ordered = counts[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        self.members, self.starts = order, np.append(np.flatnonzero(new), len(order))
        leaves = ordered[new]
        self.width = int(counts.max(initial=0)) + 3
        self.levels = []
        parent = np.zeros(len(leaves), dtype=np.int64)
        for level in range(counts.shape[1]):
            keys, parent = np.unique(parent * self.width + leaves[:, level], return_inverse=True)
            self.levels.append(keys)

    def walk(self, counts: np.ndarray, less: np.ndarray, more: np.ndarray, upper: int):
        """(probe, word) for every leaf within the budgets; an edit may only touch the merged groups named by the probe."""
        probe, node = np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64)
        give, take = less >= 0, more >= 0
        for level, keys in enumerate(self.levels):
            wanted = node * self.width + np.minimum(counts[probe, level], self.width - 2)
            here = level % upper
            gives = np.flatnonzero(give & ((less[probe] == here) | (less[probe] == OWN)) & (counts[probe, level] > 0))
            takes = np.flatnonzero(take & ((more[probe] == here) | (more[probe] == OWN)))
            source = np.concatenate([np.arange(len(probe)), gives, takes])
            asked = np.concatenate([wanted, wanted[gives] - 1, wanted[takes] + 1])
            give_left = np.concatenate([give, np.zeros(len(gives), bool), give[takes]])
            take_left = np.concatenate([take, take[gives], np.zeros(len(takes), bool)])
            at = np.searchsorted(keys, asked)
            hit = keys[np.minimum(at, len(keys) - 1)] == asked
            probe, node, give, take = probe[source[hit]], at[hit], give_left[hit], take_left[hit]
        even = np.where(more[probe] >= 0, give == take, ~give)  # a replaced letter, or a deleted one
        probe, node = probe[even], node[even]
        sizes = self.starts[node + 1] - self.starts[node]
        first = np.repeat(self.starts[node], sizes)
        offset = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(probe, sizes), self.members[first + offset]


def one_edit(a: str, b: str) -> bool:
    """Are two different words at most one inserted, deleted or replaced code point apart?"""
    if abs(len(a) - len(b)) > 1:
        return False
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    tail = next((i for i in range(least) if a[-1 - i] != b[-1 - i]), least)
    return head + tail >= max(len(a), len(b)) - 1


class Verifier:
    """``one_edit`` for many pairs of one list of words at once."""

    def __init__(self, words: list[str]) -> None:
        self.words, self.lengths = words, np.array([len(w) for w in words])
        width = min(ROW, int(self.lengths.max(initial=0)))
        short = [w if len(w) <= ROW else "" for w in words]
        self.left = self._matrix([w.ljust(width, "\0") for w in short], width)
        self.right = self._matrix([w.rjust(width, "\0") for w in short], width)

    @staticmethod
    def _matrix(padded: list[str], width: int) -> np.ndarray:
        return np.frombuffer("".join(padded).encode("utf-32-le"), dtype="<u4").reshape(len(padded), width)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        la, lb = self.lengths[a], self.lengths[b]
        least, most = np.minimum(la, lb), np.maximum(la, lb)
        plain = np.flatnonzero((most <= ROW) & (most - least <= 1))
        for part in np.array_split(plain, max(1, len(plain) // 50_000)):
            x, y = a[part], b[part]
            head = self._run(self.left[x] == self.left[y])
            tail = self._run((self.right[x] == self.right[y])[:, ::-1])
            both = np.minimum(head, least[part]) + np.minimum(tail, least[part])
            out[part] = both >= most[part] - 1
        for k in np.flatnonzero(most > ROW):
            out[k] = one_edit(self.words[a[k]], self.words[b[k]])
        return out

    @staticmethod
    def _run(equal: np.ndarray) -> np.ndarray:
        return np.where(equal.all(axis=1), equal.shape[1], np.argmin(equal, axis=1))


def _joined(upper: int):
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("n", pa.int64()), ("form", pa.string())])

    def join(group: pa.Table) -> pa.Table:
        less, more = (group.column(c).to_numpy() for c in ("less", "more"))
        stand, seek = np.flatnonzero(less == -1), np.flatnonzero(less >= 0)
        if not len(stand) or not len(seek):
            return schema.empty_table()
        each = group.column("word").to_pylist()
        n = group.column("n").to_numpy()
        counts = vectors(each)
        trie, verify = Trie(counts[stand]), Verifier(each)
        found_a, found_b = [], []
        for part in np.array_split(seek, max(1, len(seek) // CHUNK)):
            probe, word = trie.walk(counts[part], less[part], more[part], upper)
            a, b = part[probe], stand[word]
            good = verify.holds(a, b)
            a, b = a[good], b[good]
            once = np.array([less[x] != OWN or each[x] < each[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype=bool)
            found_a.append(a[once])
            found_b.append(b[once])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        if not len(a):
            return schema.empty_table()
        names = np.unique(np.concatenate([a, b]))
        ordered = sorted({each[k] for k in names.tolist()})
        rank = {w: k for k, w in enumerate(ordered)}
        which = np.zeros(len(each), dtype=np.int64)
        which[names] = [rank[each[k]] for k in names.tolist()]
        one, other, size = np.concatenate([which[a], which[b]]), np.concatenate([which[b], which[a]]), np.concatenate([n[b], n[a]])
        order = np.lexsort((other, -size, one))
        one, other, size = one[order], other[order], size[order]
        first = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
        return pa.table([pa.array([ordered[k] for k in one[first].tolist()], pa.string()), pa.array(np.diff(np.append(first, len(one)))),
                         pa.array(size[first]), pa.array([ordered[k] for k in other[first].tolist()], pa.string())], schema=schema)

    return join


def near_words(words: DataFrame, block: int = BLOCK, probes: int = PROBES) -> DataFrame:
    """(word, n_near, form_n, form) of every word with a near word; ``words``: distinct (word, n)."""
    upper = levels(words.count())
    rows = dealt(words, upper)
    stands = F.col("less") == -1
    paths = rows.groupBy("path").agg(F.count_if(stands).alias("_words"), F.count_if(~stands).alias("_probes")).where("_words > 0 AND _probes > 1")
    blocks = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    paths = stored(paths.select("path", blocks("_words", block).alias("_s"), blocks("_probes", probes).alias("_t")), "paths")
    own = lambda c: F.pmod(F.xxhash64("word", "less", "more"), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    spread = rows.join(paths, "path").withColumn("_s", F.explode(F.when(stands, F.array(own("_s"))).otherwise(every("_s")))).withColumn(
        "_t", F.explode(F.when(stands, every("_t")).otherwise(F.array(own("_t")))))
    found = spread.select("path", "_s", "_t", "word", "n", "less", "more").groupBy("path", "_s", "_t").applyInArrow(
        _joined(upper), "word string, n_near long, n long, form string")
    best = F.min(F.struct((-F.col("n")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.n")).alias("form_n"), "best.form")


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per row of ``words``: distinct (word, n)."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms are followed until no word is so much more frequent")
    words = stored(words.select("word", "n"), "words")
    near = words.join(near_words(words), "word", "left")
    accepted = F.col("form_n") >= ratio * F.col("n")
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                              F.when(accepted, F.col("form")).alias("form"), F.when(accepted, F.col("form_n")).alias("form_n")), "near")
    hops = near.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n"), F.min("n")).first()
    longest = int(math.log(most[0] / max(1, most[1]), ratio) + 1e-9) if most[0] else 0  # a form is ``ratio`` times as frequent
    for _ in range(longest.bit_length()):
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        hops = stored(hops.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "hops")
    return near.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(run_counts(table(spark, sf_dir, "documents")))


ORACLE = r"""
WITH RECURSIVE bits AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc
                        FROM range(0, 256) r(i)),
runs AS (SELECT doc_id, r, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM documents)
  WHERE length(r) >= 7 GROUP BY ALL),
hashed AS (SELECT r, n, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR) || ':' || r)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
  lambda a, b: xor(a >> 8, crc[CAST(xor(a, b) & 255 AS BIGINT) + 1]), 4294967295)) AS h FROM runs, bits),
kept AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM pairs GROUP BY word),
said AS (SELECT w.word, w.n, CASE WHEN form_n >= 10 * w.n THEN form END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN near ON near.word = w.word),
steps AS (SELECT word, word AS root FROM said UNION ALL SELECT s.word, t.form FROM steps s JOIN said t ON t.word = s.root WHERE t.form IS NOT NULL)
SELECT s.word, s.form, steps.root, s.n, s.n_near, s.form_n FROM said s JOIN steps ON steps.word = s.word
JOIN said last ON last.word = steps.root AND last.form IS NULL
"""
QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES = {"op13_spelling_variants": ORACLE}
