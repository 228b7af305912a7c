"""Operator 9 [native]: quality rules evaluated once into a ledger of failure bits, judged by versioned policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import computed_once
from .words import WORD_PATTERN

SPACE = r"[\x20\x09-\x0D]+"
#: Rules by the place of their bit: name, and the SQL over the measurements that is true for a failure.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 15 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("capitals", "10 * n_capitals > 4 * word_chars"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Policies by version: the bits that reject a document.
POLICIES = {"v1": BASE, "v2": sum(BIT.values())}
CURRENT = "v2"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements as longs and ``fail_bits``, one bit for each rule of RULES.

    A null text measures like an empty one: it has no words and fails few_words
    alone, since 0 exceeds nothing. Columns of ``docs`` that have the name of a
    measurement are replaced. One pass over the rows, no shuffle; only built-in
    functions. A text's words are held as one array, so memory follows the
    longest text.

    Three-word windows are compared within a text by a 64-bit hash of the three
    words: sorting (hash, place) puts equal windows side by side.
    """
    own = [c for c in docs.columns if c not in {*MEASURES, "fail_bits", "_words", "_windows", "_lines", *[f"_{m}" for m in MEASURES]}]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*own, F.array_remove(F.split(text, SPACE), "").alias("_words"), F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD_PATTERN)).alias("_lines"), _only(text, r"#*$%&|<>").alias("n_symbols"), _only(text, r"\p{Lu}").alias("n_capitals"))
    w = F.col("_words")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")))
    windows = F.when(F.size(w) >= 3, F.sort_array(windows)).otherwise(F.expr("cast(array() as array<struct<h:bigint,at:int>>)"))
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_lines": F.size("_lines"),
        "n_capitals": F.col("n_capitals"),
    }
    rows = rows.select(*own, *[c.cast("long").alias(name) for name, c in counts.items()], windows.alias("_windows"))
    costly = [F.col(name).alias(f"_{name}") for name in counts]
    rows = computed_once(rows, *costly, _covered(F.col("_windows")).cast("long").alias("_n_repeat_words"))
    rows = rows.select(*own, *[F.col(f"_{name}").alias(name) for name in MEASURES])
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES]
    fail = bits[0]
    for b in bits[1:]:
        fail = fail.bitwiseOR(b)
    return rows.select(*own, *MEASURES, fail.cast("long").alias("fail_bits"))


def _only(text: Column, chars: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash stands next to an equal one; the windows are sorted."""
    twice = F.filter(windows, lambda x, i: F.coalesce(F.get(windows, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(windows, i + 1)["h"] == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["at"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda a, at: F.struct((at + 3).alias("end"), (a["n"] + at + 3 - F.greatest(a["end"], at)).alias("n")), lambda a: a["n"])


def judged(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under a policy to rows of a ledger."""
    return rows.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy] | BASE)) == 0)


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that would be kept without it.

    Documents are first counted by failure bits, at most 2 ** len(RULES) groups,
    so the rules are never evaluated again. An empty ledger gives zeros.
    """
    mask = POLICIES[policy]
    by_bits = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    total = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).cast("long")
    parts = []
    for name, _ in RULES:
        if mask & BIT[name]:
            failed = F.col("bits").bitwiseAND(F.lit(BIT[name])) != 0
            parts.append(F.struct(F.lit(name).alias("rule"), total(failed).alias("n_failed"), total(F.col("bits") == BIT[name]).alias("n_failed_alone"), total(F.col("bits").bitwiseAND(F.lit(mask & ~BIT[name])) == 0).alias("n_kept_without"), total(F.col("bits") == 0).alias("n_kept")))
    return by_bits.agg(F.array(*parts).alias("a")).select(F.inline("a"))


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (
  select doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
    length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) as n_capitals
  from d
),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as t from w, range(1, len(w) - 1) r(i)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, t) as n from g) where n > 1),
c as (select doc_id, sum(least(3, coalesce(nxt - i, 3))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from r) group by doc_id),
m as (
  select w.doc_id, len(w.w)::bigint as n_words, length(array_to_string(w.w, ''))::bigint as word_chars, n_symbols::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines, n_capitals::bigint as n_capitals
  from w left join c on c.doc_id = w.doc_id
),
b as (
  select *, ((n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (4 * n_symbols > n_words)::int + 8 * (2 * n_dup_lines > n_lines)::int
    + 16 * (word_chars > 15 * n_words)::int + 32 * (word_chars < 2 * n_words)::int + 64 * (10 * n_capitals > 4 * word_chars)::int)::bigint as fail_bits from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, fail_bits, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept from b
"""
