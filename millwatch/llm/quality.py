"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per
rule; a policy is a versioned set of rules, so applying or comparing policies never reads a text again.

NULL and empty texts measure zero everywhere and fail ``few_words``. Other columns are carried along
untouched when ``keep`` names them; rows are never dropped, repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[], Column]


#: Bit i of the ledger belongs to rule i; append only, so that stored ledgers stay readable.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda: F.col("n_words") < 10),
    Rule("repeated_words", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words")),
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", lambda: F.col("word_chars") > 40 * F.col("n_words")),
    Rule("repeated_lines", lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    Rule("capitals", lambda: 2 * F.col("n_capitals") > F.col("word_chars")),
)
#: Versioned policies by rule names.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "2024-1": ("few_words", "repeated_words", "symbols", "short_words", "long_words"),
    "2024-2": ("few_words", "repeated_words", "symbols", "short_words", "long_words", "repeated_lines", "capitals"),
}
CURRENT = "2024-2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    known = [r.name for r in rules]
    return sum(1 << known.index(n) for n in set(names))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window_at(words_: Column, i: Column) -> list[Column]:
    return [F.get(words_, i + k) for k in range(WINDOW)]


def _covered(positions: Column) -> Column:
    """Words covered by windows that start at the given ascending positions."""
    steps = F.transform(positions, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, j + 1) - p, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def _repeat_words(words_: Column) -> Column:
    """Words in windows found twice or more in the text.

    Hashes settle the usual case: if they are all distinct, no window repeats. Else the windows
    themselves are sorted with their positions and compared with their neighbours, so a hash
    collision costs time and never a wrong count.
    """
    starts = F.slice(words_, F.lit(1), F.greatest(F.size(words_) - (WINDOW - 1), F.lit(0)))
    hashes = F.transform(starts, lambda _, i: F.xxhash64(*_window_at(words_, i)))
    windows = F.transform(starts, lambda _, i: F.struct(F.concat_ws(" ", *_window_at(words_, i)).alias("g"), i.alias("p")))

    def repeated(s: Column) -> Column:
        same = lambda e, j: F.coalesce(e["g"] == F.get(s, j)["g"], F.lit(False))
        found = F.transform(s, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["p"]))
        return _let(F.sort_array(F.filter(found, lambda p: p.isNotNull())), _covered)

    distinct = F.size(F.array_distinct(hashes)) >= F.size(words_) - (WINDOW - 1)
    return F.when(distinct, F.lit(0)).otherwise(_let(F.sort_array(windows), repeated))


def measurements(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The measurements all rules are stated in, one row per document."""
    t = F.col("_t")
    without = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    return (
        docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
        .select(*keep, "_t", words(t).alias("_w"), lines.alias("_l"))
        .select(
            *keep,
            F.size("_w").cast("long").alias("n_words"),
            without("[ \t-\r]+").cast("long").alias("word_chars"),
            (F.length(t) - without("[#*$%&|<>]+")).cast("long").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            _repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
            F.size("_l").cast("long").alias("n_lines"),
            (F.length(t) - without("[A-Z]+")).cast("long").alias("n_capitals"),
        )
    )


def ledger(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """``keep`` columns, measurements and ``fail_bits`` (bit i set: rule i failed)."""
    bits = [F.when(r.fails(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measurements(docs, text, keep).withColumn("fail_bits", total)


def verdict(policy: str, rules: Sequence[Rule] = RULES) -> Column:
    """True where no rule of the policy failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy], rules)).cast("long")) == 0


def ablation(entries: DataFrame, policy: str = CURRENT, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of the policy: documents it fails, documents only it fails, documents kept without it.

    One aggregation counts the ledger by bit pattern (2^rules rows at most); all figures follow from
    the patterns by bitwise operations. An empty ledger gives zeros.
    """
    names = [r.name for r in rules if r.name in POLICIES[policy]]
    whole = mask(names, rules)
    hit = F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long"))
    patterns = entries.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))
    bit = {n: F.lit(mask([n], rules)).cast("long") for n in names}
    zero = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    rows = patterns.agg(
        *[zero(F.col("hit").bitwiseAND(bit[n]) != 0).alias(f"failed_{n}") for n in names],
        *[zero(F.col("hit") == bit[n]).alias(f"only_{n}") for n in names],
        zero(F.col("hit") == 0).alias("kept"),
    )
    each = [F.struct(F.lit(n).alias("rule"), F.col(f"failed_{n}").alias("failed"), F.col(f"only_{n}").alias("only_this"),
                     (F.col("kept") + F.col(f"only_{n}")).alias("kept_without")) for n in names]
    return rows.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger(table(spark, sf_dir, "documents"))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES["base"])).cast("long")) != 0
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), verdict(CURRENT).alias("kept"), "n_lines", "n_capitals", "fail_bits",
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '') AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
f AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END)
             + (CASE WHEN 2 * n_capitals > word_chars THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, n_lines, n_capitals, fail_bits FROM f
"""
QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES = {"op3_quality_rules": ORACLE}
