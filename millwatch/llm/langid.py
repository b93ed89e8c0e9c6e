"""Language identification by prediction by partial matching (PPM-C).

Per language a tree of byte contexts of every length up to four is counted over all labelled training texts, and frozen into code
lengths: a byte seen after its four predecessors costs by its share there; if it was not, the escape probability of
that context is paid and the context without its first byte decides, down to the empty context and at last to 256 equally likely
bytes. A context never seen costs nothing to leave. A text costs the sum over its bytes and an end mark, the language with the shortest
code is the prediction (ties: the smaller name), and the score is its posterior under equal priors. Lengths are whole
units of 2^-16 bit, so sums do not depend on partitions or batches.

A-Z count as a-z, digits as one byte, blanks and controls as another; all other bytes are themselves. The trees are sparse: of each
length only contexts that occurred are kept, with the lengths of all languages side by side. ``table_bytes`` bounds each of the five
tables, also with many labels or a corpus of noise; beyond it the rarest of its contexts and bytes count as never seen.

NULL texts and texts without a letter get ``und`` and score 0, as does everything if nothing was learned.
Rows whose id is NULL are held out. Repeated rows count and are answered each; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, release, slices, stored, table, texts, unboxed

ORDER = 4
FOLD = bytes(32 if b <= 32 or b == 127 else b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
MARK = bytes(ORDER)  # no folded text holds a zero byte; the first one after a text is its end mark
UNIT = 1 << 16
TABLE_BYTES = 64 << 20
UNKNOWN = "und"
#: A text goes if its code is longer than this many times what its language's own texts take, and by so many bits more.
EXCESS, SLACK = 2.0, 128.0


def held_out(doc_id: str = "doc_id") -> Column:
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % 5 == 0, F.lit(True))


def grams(each: list[bytes], block: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, starts, grams, used) by blocks of bytes: each byte with its predecessors in one number, and whether it counts.

    ``starts`` cuts the block into the texts it holds, the first one possibly begun before.
    """
    joined = np.frombuffer(MARK + b"".join(t.translate(FOLD) + MARK for t in each), dtype=np.uint8)
    ends = np.cumsum([len(t) + ORDER for t in each])
    for start in range(0, len(joined) - ORDER, block):
        stop = min(start + block, len(joined) - ORDER)
        part = joined[start:stop + ORDER].astype(np.int64)
        packed = part[:stop - start].copy()
        for k in range(1, ORDER + 1):
            packed <<= 8
            packed |= part[k:k + stop - start]
        first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop - 1, side="right")
        used = (part[ORDER:] != 0) | (part[ORDER - 1:-1] != 0)  # of the marks only the first
        empty = [k for k in range(first, last + 1) if not each[k]]
        for k in empty:  # an empty text is its end mark alone, right after other marks
            at = ends[k] - ORDER - start
            if 0 <= at < len(used):
                used[at] = True
        yield first, np.concatenate(([0], ends[first:last] - start)), packed, used


def counts(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): how often each byte follows its four predecessors per language, over all rows."""
    def merged(parts):
        if len(parts) == 1:
            return parts[0]
        keys, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return keys, np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def rows(found):
        for name, parts in found.items():
            gram, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

    def size(found):
        return sum(len(g) for parts in found.values() for g, _ in parts)

    def count(batches):
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in slices(batches, text, 2_000_000):
            by: dict[str, list[bytes]] = {}
            for name, t in zip(batch.column(lang).to_pylist(), texts(batch, text), strict=True):
                by.setdefault(name, []).append(t)
            for name, each in by.items():
                for _, _, packed, used in grams(each, 1 << 19):
                    found.setdefault(name, []).append(np.unique(packed[used], return_counts=True))
            if size(found) > 1_500_000:
                found = {name: [merged(parts)] for name, parts in found.items()}
                if size(found) > 1_000_000:
                    yield from rows(found)
                    found = {}
        yield from rows(found)
        del found
        release()
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    return usable.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Contexts of one length: code lengths of each (context, byte) and of leaving each context, by language."""

    keys: np.ndarray
    lengths: np.ndarray
    slots: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the asked keys and whether they are there: by a table of hashes, and by bisection where that holds another key."""
        at = self.slots[_slot(asked, len(self.slots))].astype(np.int64)
        hit = self.keys[at] == asked
        miss = np.flatnonzero(~hit)
        if len(miss):
            again = np.minimum(np.searchsorted(self.keys, asked[miss]), len(self.keys) - 1)
            at[miss], hit[miss] = again, self.keys[again] == asked[miss]
        return at, hit

    def leave(self, contexts: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return np.where((self.contexts[at] == contexts)[:, None], self.escapes[at], 0)


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]

    def lengths(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """[gram, language]: code lengths in units of 2^-16 bit."""
        if order < 0:
            return np.full((len(packed), len(self.languages)), 8 * UNIT, dtype=np.int32)
        level = self.levels[order]
        at, hit = level.find(packed)
        out = level.lengths[at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            out[miss] = level.leave(packed[miss] >> 8) + self.lengths(packed[miss] & ((1 << 8 * order) - 1), order - 1)
        return out


def _level(below: Model, keys: np.ndarray, n: np.ndarray, order: int) -> Level:
    """Freeze the counts n[key, language] of one context length; ``below`` holds the shorter ones."""
    contexts, place = np.unique(keys >> 8, return_inverse=True)
    starts = np.flatnonzero(np.append(True, np.diff(place) > 0))
    total, kinds = np.add.reduceat(n, starts, axis=0), np.add.reduceat((n > 0).astype(np.int64), starts, axis=0)
    whole = total + kinds
    escapes = np.where(kinds > 0, np.rint(np.log2(np.maximum(whole, 1) / np.maximum(kinds, 1)) * UNIT), 0).astype(np.int32)
    own = np.rint(np.log2(np.maximum(whole, 1)[place] / np.maximum(n, 1)) * UNIT).astype(np.int32)
    lengths = np.where(n > 0, own, escapes[place] + below.lengths(keys & ((1 << 8 * order) - 1), order - 1))
    slots = np.zeros(1 << max(10, int(2 * len(keys) - 1).bit_length()), dtype=np.int32)
    rare_first = np.argsort(n.sum(axis=1), kind="stable")
    slots[_slot(keys[rare_first], len(slots))] = rare_first  # the most frequent key of a slot stays
    return Level(keys, lengths.astype(np.int32), slots, contexts, escapes)


def _kept(rows: DataFrame, most: int) -> DataFrame:
    """Of more than ``most`` grams the most frequent ones, by a lower bound of their counts. ``rows`` are stored."""
    if rows.count() <= most:
        return rows
    by_gram = stored(rows.groupBy("gram").agg(F.sum("n").alias("all")), "grams")
    steps = by_gram.groupBy(F.floor(4 * F.log2("all")).alias("step")).agg(F.count("*").alias("grams")).orderBy(F.desc("step")).collect()
    room, least = most, 0
    for row in steps:
        room -= row["grams"]
        if room < 0:
            least = row["step"] + 1
            break
    if not least:
        return rows
    return rows.join(by_gram.where(F.floor(4 * F.log2("all")) >= least).select("gram"), "gram", "left_semi")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", table_bytes: int = TABLE_BYTES) -> Model:
    """Freeze the trees of all languages; what reaches the driver is bounded by ``table_bytes`` per context length."""
    rows = stored(counts(labelled, text, lang), "grams")
    languages = sorted((r[0] for r in rows.select("lang").distinct().collect()), key=lambda x: x.encode())
    model = Model(languages, [])
    number = (F.array_position(F.lit(languages), F.col("lang")) - 1).cast("int") if languages else F.lit(0)
    for order in range(ORDER + 1 if languages else 0):
        shorter = rows.groupBy(number.alias("lang"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        found = _kept(stored(shorter, "grams"), max(256, table_bytes // (8 * len(languages)))).select("gram", "lang", "n").toArrow()
        keys, place = np.unique(found["gram"].to_numpy(), return_inverse=True)
        n = np.zeros((len(keys), len(languages)), dtype=np.int64)
        n[place, found["lang"].to_numpy()] = found["n"].to_numpy()
        model.levels.append(_level(model, keys, n, order))
    return model


def code_lengths(model: Model, each: list[bytes], block: int = 1 << 18) -> np.ndarray:
    """[language, text]: code length of every text with its end mark."""
    out = np.zeros((len(each), len(model.languages)), dtype=np.int64)
    for first, starts, packed, used in grams(each, block):
        lengths = model.lengths(packed)
        lengths[~used] = 0
        out[first:first + len(starts)] += np.add.reduceat(lengths, starts, axis=0, dtype=np.int64)
    return out.T


def _scored(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``_bits``, the length of the shortest code."""
    plain = docs.drop(*[c for c in docs.columns if c.lower() in ("lang_pred", "score", "_has_letter", "_bits")])
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("_bits", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        for batch in slices(batches, text, 2_000_000):
            usable = np.asarray(batch.column("_has_letter").to_pylist(), dtype=bool) & bool(m.languages)
            names, scores, bits = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            at = np.flatnonzero(usable)
            if len(at):
                every = texts(batch, text)
                cost = code_lengths(m, [every[i] for i in at])
                more = np.minimum((cost - cost.min(axis=0)) / UNIT, 1000.0)
                names[at] = np.array(m.languages, dtype=object)[cost.argmin(axis=0)]
                scores[at], bits[at] = 1 / np.exp2(-more).sum(axis=0), cost.min(axis=0) / UNIT
            rest = batch.drop_columns(["_has_letter"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits)],
                                             names=[*rest.schema.names, "lang_pred", "score", "_bits"])
        release()

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return plain.withColumn("_has_letter", letter).mapInArrow(score, schema)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    return _scored(docs, model, text).drop("_bits")


def learn(docs: DataFrame) -> Model:
    """Fit on the labelled rows that are not held out."""
    return fit(docs.where(~held_out()).select("text", "lang"))


def accepted(docs: DataFrame, model: Model, languages: list[str] | None = None, least: float = 0.5, excess: float = EXCESS,
             slack: float = SLACK) -> DataFrame:
    """``docs`` in a known (or one of the named) language with at least the score; same columns and values, whatever their names.

    A text of an unlearned language has a clear nearest language too, but a long code. It goes when its code exceeds ``excess`` times
    the bits per byte of the language's own texts that were not learned from, and ``slack`` bits, which spares short texts.
    """
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    if languages is not None:
        good &= F.col("lang_pred").isin(languages)
    own = _scored(docs.where(held_out() & F.col("lang").isNotNull()).select("text", F.col("lang").alias("own")), model, "text")
    known = own.where(F.col("own") == F.col("lang_pred")).groupBy("lang_pred").agg(
        (F.sum("_bits") / F.sum(F.octet_length("text") + 1)).alias("rate")).collect()
    rate = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for r in known for v in (r["lang_pred"], r["rate"])]), F.col("lang_pred"))
                      if known else F.lit(None), F.lit(8.0 * excess))
    good &= F.col("_bits") <= F.lit(slack) + F.lit(excess) * rate * (F.octet_length("text") + 1)
    return unboxed(_scored(boxed(docs, "text"), model, "text").where(good), docs.columns, "text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    answers = predict(docs.select("doc_id", "text", held_out().alias("held_out")), learn(docs))
    return answers.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
