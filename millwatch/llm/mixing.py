"""Mixing sources to target weights with a low-discrepancy schedule.

Targets: every source has a weight, all sources share the corpus size by weight, and no target exceeds
``most`` times the size of its source; the excess is shared again by weight until none is above.

Schedule: slot i of 2^m slots stands at the van der Corput point bitreverse(i) / 2^m. The cumulative
targets cut [0, 1) into one interval per source, and a slot belongs to the source its point falls into, so
every prefix of the schedule holds each source in nearly its share. A source whose interval holds no point
shares the slot of the point below it. Slots are ranked per source. Each source is shuffled by a hash of its
documents and read around and around for exactly its target, rounded to a word; its slots divide those words evenly, by
rank, and join the documents whose words they read. A document's words taken are the sum over these slots; a slot may begin and
end inside a document.

Documents without words take no part (taken 0). NULL is a source of its own, after all others. Ties and
repeated rows share a hash and stand side by side. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, word_count

MOST = 3
BLOCK_TOKENS = 64
#: Ranges a source's shuffled documents, the points and the slots are dealt into, to number them in parallel.
CELLS = 4096


def key(source: str = "source") -> Column:
    """A source as a joinable text; sorts by code point with NULL last."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~"))


def sources(sized: DataFrame) -> DataFrame:
    """(key, place, source_size, weight): weights 1, 2, 3, repeating in the order of the keys.

    Distinct sources are numbered over ranges of keys, so no task sees them all.
    """
    each = stored(sized.groupBy("key").agg(F.sum("size").alias("source_size")), "sources")
    ranged = stored(each.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    place = F.col("before") + F.col("own")
    return ranged.withColumn("own", own).join(parts, "part").select("key", "source_size", place.alias("place"), (place % 3 + 1).alias("weight"))


def targets(weighted: DataFrame, most: int = MOST) -> DataFrame:
    """Add ``target`` and the cumulative share [low, high) of every source.

    Rounds of one small aggregation; what reaches the driver is one row per round.
    """
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        above = F.col("source_size") * most < F.col("weight") * F.lit(level)
        held, open_, n = weighted.agg(F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)),
                                      F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)), F.count_if(above)).first()
        if n == capped or not open_:
            break
        level, capped = (total - most * held) / open_, n
    goal = F.least(F.col("source_size") * most, F.col("weight") * F.lit(level)).cast("double")
    goals = stored(weighted.withColumn("target", goal).withColumn("units", F.round(goal * 1024).cast("long")), "targets")
    # Whole numbers, summed over ranges of places and then within each range, so neighbours share their border.
    whole = goals.agg(F.sum("units")).first()[0] or 1
    ranged = goals.withColumn("part", F.floor(F.col("place") / CELLS))
    sums = ranged.groupBy("part").agg(F.sum("units").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(sums.select("part", before.alias("before")), "part").withColumn("run", F.col("before") + F.sum("units").over(upto))
    return joined.select("key", "place", "source_size", "weight", "target",
                         ((F.col("run") - F.col("units")) / F.lit(whole)).alias("low"), (F.col("run") / F.lit(whole)).alias("high"))


def mirrored(number: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a number in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(number), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def point(share: str, bits: int) -> Column:
    """The first of 2^bits points that is not below a cumulative share."""
    return F.ceil(F.col(share) * (1 << bits)).cast("long")


def schedule(goals: DataFrame, bits: int) -> DataFrame:
    """(slot, key, rank): the source of each of 2^bits slots and the slot's rank within its source."""
    spark = goals.sparkSession
    slots = 1 << bits
    grid = min(bits, 10)
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", mirrored(F.col("slot"), bits))
    points = points.withColumn("cell", F.shiftright("point", bits - grid))
    # The points are whole numbers, so an interval is a range of them; rows: sources + 2^grid at most.
    edges = goals.select("key", point("low", bits).alias("from"), point("high", bits).alias("to"))
    edges = edges.where(F.col("to") > F.col("from")).withColumn(
        "cell", F.explode(F.sequence(F.shiftright("from", bits - grid), F.shiftright(F.col("to") - 1, bits - grid))))
    owned = points.join(edges, "cell").where((F.col("point") >= F.col("from")) & (F.col("point") < F.col("to")))
    owned = owned.select("slot", "key", F.floor(F.col("slot") / 65536).alias("chunk"))
    counts = owned.groupBy("key", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("key", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot")) - 1
    return owned.withColumn("own", own).join(counts, ["key", "chunk"]).select("slot", "key", (F.col("before") + F.col("own")).alias("rank"))


def streams(sized: DataFrame, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``start``: where the document's words begin in the shuffled stream of its source."""
    mixed = sized.withColumn("h", F.xxhash64(F.lit("mix"), *order)).withColumn("cell", F.pmod("h", F.lit(CELLS)))
    sums = mixed.groupBy("key", "cell").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("key", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    upto = Window.partitionBy("key", "cell").orderBy("h", *[F.col(c).asc_nulls_last() for c in order], "size").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum("size").over(upto) - F.col("size")
    return mixed.withColumn("own", own).join(sums, ["key", "cell"]).withColumn("start", F.col("before") + F.col("own")).drop("h", "cell", "own", "before")


def mix(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, most: int = MOST, text: str = "text",
        source: str = "source", order: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The mix by document and by slot; a document's words are those that the slots read of it.

    First (order column, size, source_size, target, taken, first_slot), one row per row of ``docs``; ``first_slot`` is
    the slot that reads its first word, NULL if it is not taken. Second (slot, key, rank, start, words): the order in which the
    sources' shuffled streams are to be read. ``start`` counts on through the passes: it is word start modulo source_size.
    """
    return _mix(docs, text, source, (order,), block_tokens, most)


def _mix(docs: DataFrame, text: str, source: str, order_by: tuple[str, ...], block_tokens: int = BLOCK_TOKENS,
         most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """``mix`` of documents named by several columns."""
    sized = stored(docs.select(*order_by, key(source).alias("key"), word_count(F.col(text)).alias("size")), "sizes")
    goals = stored(targets(sources(sized), most), "goals")
    total = goals.agg(F.sum("source_size")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(total, 1) / block_tokens)))
    # Of n slots the first ``more`` read ``each`` + 1 words, the others ``each``.
    n_slots = point("high", bits) - point("low", bits)
    shares = goals.withColumn("words", F.round("target").cast("long")).where(F.col("words") > 0).withColumn("n", F.greatest(n_slots, F.lit(1)))
    shares = shares.withColumn("more", F.col("words") % F.col("n")).withColumn("each", F.expr("words div n"))
    below = F.least(F.floor(F.col("low") * (1 << bits)).cast("long"), F.lit((1 << bits) - 1))
    guests = shares.where(n_slots == 0).select(mirrored(below, bits).alias("slot"), "key", F.lit(0).cast("long").alias("rank"))
    ranked = schedule(goals, bits).select("slot", "key", "rank").union(guests)
    slots = ranked.join(shares.select("key", "more", "each"), "key").select(
        "slot", "key", "rank", (F.col("rank") * F.col("each") + F.least("rank", "more")).alias("start"),
        (F.col("each") + (F.col("rank") < F.col("more")).cast("long")).alias("words"))

    # Every pass over a document's words is a range of slots; each slot reads what of the range lies within it.
    placed = stored(streams(sized, order_by), "streams")
    shares = shares.select("key", "words", "more", "each")
    passes = placed.join(shares.join(goals.select("key", "source_size"), "key"), "key").where("size > 0").select(
        "key", "start", "size", "words", "more", "each",
        F.explode(F.expr("transform(sequence(0L, (words - 1) div source_size), p -> p * source_size + start)")).alias("from"))
    passes = passes.where(F.col("from") < F.col("words")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words")))
    at = "if({0} < more * (each + 1), {0} div (each + 1), more + ({0} - more * (each + 1)) div greatest(each, 1))"
    ranks = F.sequence(F.expr(at.format("`from`")), F.expr(at.format("(`to` - 1)")))
    reads = passes.select("key", "start", "from", "to", F.explode(ranks).alias("rank")).join(
        slots.select("key", "rank", "slot", F.col("start").alias("begin"), (F.col("start") + F.col("words")).alias("end")), ["key", "rank"])
    within = F.least("to", "end") - F.greatest("from", "begin")
    # Documents with words begin at places of their own.
    taken = reads.groupBy("key", "start").agg(F.sum(within).alias("taken"), F.min_by("slot", F.greatest("from", "begin")).alias("first_slot"))
    taken = taken.select("key", "start", "taken", "first_slot", F.lit(True).alias("worded"))
    told = placed.withColumn("worded", F.when(F.col("size") > 0, True)).join(goals.select("key", "source_size", "target"), "key")
    told = told.join(taken, ["key", "start", "worded"], "left")
    by_doc = told.select(*order_by, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
    return by_doc, slots


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with every document as often as the schedule's slots read it, to the nearest whole copy; same columns and values.

    Equal rows (id, text and source) are repeated alike, each by their mean; rows without id are told apart by text and source.
    """
    box = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"),
                      F.col(source).alias("source"), F.xxhash64(F.col(text), F.lit("/"), F.col(source)).alias("print"))
    each = _mix(box.select("doc_id", "print", "text", "source"), "text", "source", ("doc_id", "print"), **options)[0]
    copies = F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int")
    each = each.where("size > 0").groupBy(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).agg(copies.alias("_copies")).where("_copies > 0")
    taken = box.select("_row", "doc_id", "print").join(each, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")))
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0]


QUERIES = {"op6_mix_sources": op6_mix_sources}
ORACLES: dict[str, str] = {}
