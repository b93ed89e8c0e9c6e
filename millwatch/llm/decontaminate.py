"""Benchmark decontamination with a broadcast set of test n-grams.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. A window is ``n``
consecutive words of an item; a shorter item with a word is one window. The benchmark is collected in
slices of a bounded number of words (``slice_words``); each slice becomes one broadcast index, and the
documents pass through the slices one after another, stored in between, so a benchmark of any size is handled whole and
neither a broadcast nor a task exceeds the bound unless a single item does. Documents are only read, never shuffled.

NULL texts have no words, NULL items no windows. Windows of an item without an id hit words, but the
item is not counted. Repeated rows give repeated results; empty tables give no rows or no hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, slices, stored, table, texts, unboxed

#: Bytes of a word stay (A-Z lower-cased), all other ASCII becomes a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SLICE_WORDS = 2_000_000
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def item_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Index:
    """Windows of some items: word numbers, window hashes by length, and the items of every window."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int) -> None:
        self.n = n
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            found = item_words(text)
            if not found:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], dtype=np.uint32)
            size = min(n, len(ids))
            known = self.windows.setdefault(size, {})
            for i in range(len(ids) - size + 1):
                known.setdefault(ids[i:i + size].tobytes(), set()).update([] if item is None else [item])
        self.hashes = {}
        for size, known in self.windows.items():
            each = np.frombuffer(b"".join(known), dtype=np.uint32).reshape(-1, size).astype(np.uint64)
            self.hashes[size] = np.unique((each * _powers(MULTIPLIER, size)).sum(axis=1, dtype=np.uint64))

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(start, length, items) of every window in ``ids``, where 0 stands for words no item has."""
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids.astype(np.uint64) * _powers(MULTIPLIER, len(ids)), dtype=np.uint64)))
        back = _powers(INVERSE, len(ids))
        for size, known in self.windows.items():
            if size > len(ids):
                continue
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(starts):
                continue
            hashes = (sums[starts + size] - sums[starts]) * back[starts]
            table_ = self.hashes[size]
            at = np.minimum(np.searchsorted(table_, hashes), len(table_) - 1)
            for start in starts[table_[at] == hashes].tolist():
                items = known.get(ids[start:start + size].tobytes())
                if items is not None:
                    yield start, size, items


def _indexes(benchmark: DataFrame, n: int, slice_words: int, item: str, text: str) -> Iterator[Index]:
    """One index per slice; items are dealt to slices by a hash of their row."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // (2 * slice_words)))
    for k in range(count):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield Index([(r["item"], r["text"].encode()) for r in part.distinct().toLocalIterator()], n)


def occurrences(docs: DataFrame, benchmark: DataFrame, n: int = 13, slice_words: int = SLICE_WORDS,
                text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word ranges [start, end), merged) and ``hit_items`` (sorted)."""
    added = T.StructType.fromDDL("n_words long, hit_spans array<struct<start: long, end: long>>, hit_items array<string>")
    clash = {f.name.lower() for f in added}
    plain = docs.drop(*[c for c in docs.columns if c.lower() in clash])
    out = plain.select("*", F.lit(None).cast("long").alias("n_words"), F.array().cast(added["hit_spans"].dataType).alias("hit_spans"),
                       F.array().cast("array<string>").alias("hit_items"))
    schema = T.StructType([*plain.schema.fields, *added.fields])
    for k, index in enumerate(_indexes(benchmark, n, slice_words, item, item_text)):
        if k:  # one index at a time in a task's worker, however many slices there are
            out = stored(out, "occurrences")
        shared = docs.sparkSession.sparkContext.broadcast(index)
        out = out.mapInArrow(_scanner(shared, text), schema)
    return out


def _scanner(shared, text: str):
    def scan(batches):
        index = shared.value
        number = index.vocabulary.get
        for batch in slices(batches, text):
            counts, spans, items = [], [], []
            old_spans, old_items = batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist()
            found = [(t or b"").translate(FOLD).split() for t in texts(batch, text)]
            for k, ws in enumerate(found):
                ids = np.fromiter((number(w, 0) for w in ws), dtype=np.uint32, count=len(ws))
                ranges, names = [(s["start"], s["end"]) for s in old_spans[k]], set(old_items[k])
                if ids.any():
                    for start, size, who in index.find(ids):
                        ranges.append((start, start + size))
                        names |= who
                counts.append(len(ws))
                spans.append([{"start": a, "end": b} for a, b in _merged(ranges)])
                items.append(sorted(names))
            rest = batch.drop_columns(["n_words", "hit_spans", "hit_items"])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))],
                names=[*rest.schema.names, "n_words", "hit_spans", "hit_items"])
    return scan


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def n_hit() -> F.Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def contaminated(share: int = 20) -> F.Column:
    """At least one word in ``share`` is hit."""
    return (n_hit() > 0) & (share * n_hit() >= F.col("n_words"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, text: str = "text", **names) -> DataFrame:
    """``docs`` without the contaminated documents; same columns and values, whatever their names."""
    kept = occurrences(boxed(docs, text), benchmark, n, text=text, **names).where(~contaminated(share))
    return unboxed(kept, docs.columns, text)


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13, text: str = "text", **names) -> DataFrame:
    """``docs`` with every hit word, and what stands between hit words of a span, cut from the text."""
    def cut(batches):
        for batch in slices(batches, text):
            out = []
            for t, spans in zip(texts(batch, text), batch.column("hit_spans").to_pylist(), strict=True):
                if t is not None and spans:
                    at = [m.span() for m in WORD.finditer(t)]
                    for s in reversed(spans):
                        t = t[:at[s["start"]][0]] + t[at[s["end"] - 1][1]:]
                out.append(t)
            k = batch.schema.get_field_index(text)
            yield batch.set_column(k, text, pa.array(out, pa.binary()).cast(pa.string()))
    found = occurrences(docs, benchmark, n, text=text, **names)
    return found.mapInArrow(cut, found.schema).select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM bw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, sizes WHERE len(ws) >= n)),
h AS (SELECT dg.doc_id, dg.i, dg.n, bg.item_id FROM dg JOIN bg ON bg.n = dg.n AND bg.g = dg.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN c ON c.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id
"""
QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLES = {"op8_decontaminate": ORACLE}
