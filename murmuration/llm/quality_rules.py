"""Quality rules as a ledger of failure bits.

Each rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule. A policy is
a versioned mask over those bits: a document passes if no masked bit is set. Ablations (what a rule drops alone, and
what would come back without it) are sums over the bits, without a second look at the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import WHITE_SPACE, WHITE_SPACE_RUN

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails` (SQL over the measurements) is true."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "shouting", "5 * n_capitals > 4 * word_chars"),
)

#: Versioned policies: the bits that reject. Bits 0 and 1 are the base that every version holds.
BASE_BITS = (0, 1)
POLICIES = {
    "base": (0, 1),
    "v1": (0, 1, 2, 3),
    "v2": (0, 1, 2, 3, 4, 5, 6),
}
CURRENT = "v2"


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the numbers every rule is written in; null text measures as empty."""
    start = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    bare = start.withColumn("b", F.btrim(F.col("t"), F.lit(WHITE_SPACE)))
    words = bare.select(
        "doc_id",
        "t",
        F.when(F.col("b") == "", F.array().cast("array<string>")).otherwise(F.split("b", WHITE_SPACE_RUN)).alias("words"),
        F.expr(r"filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    ).withColumn("n_words", F.size("words").cast("long"))
    hashed = words.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            f"case when n_words > {WINDOW} then transform(sequence(1, size(words) - {WINDOW - 1}), "
            f"i -> xxhash64(slice(words, i, {WINDOW}))) end"
        ).alias("windows"),
    )
    # Only a text with a repeated window pays for the sort that finds which windows repeat.
    sorted_windows = hashed.withColumn(
        "runs",
        F.expr(
            "case when size(array_distinct(windows)) < size(windows) "
            "then sort_array(transform(windows, (h, i) -> struct(h as h, i as p))) end"
        ),
    ).drop("windows")
    places = sorted_windows.withColumn(
        "places",
        F.expr(
            "sort_array(transform(filter(runs, (r, i) -> (i > 0 and runs[i - 1].h = r.h) "
            "or (i + 1 < size(runs) and runs[i + 1].h = r.h)), r -> r.p))"
        ),
    ).drop("runs")
    return places.withColumn(
        "n_repeat_words",
        F.coalesce(
            F.expr(
                f"aggregate(transform(places, (p, i) -> case when i + 1 < size(places) "
                f"then least({WINDOW}, places[i + 1] - p) else {WINDOW} end), 0L, (a, x) -> a + x)"
            ),
            F.lit(0),
        ).cast("long"),
    ).drop("places")


def failure_bits(rules=RULES) -> Column:
    total = F.lit(0).cast("long")
    for rule in rules:
        total = total.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return total


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per input row: doc_id, the measurements and `failed`, the bits of the rules it fails.

    Words are runs without ASCII white space. An empty or null text has no words and fails the rule on few words.
    Repeated rows give repeated ledger rows; an empty table gives none. No shuffle and no cap on text length.
    """
    return measurements(docs, id_col, text_col).withColumn("failed", failure_bits(rules))


def passes(policy: str = CURRENT) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def ablation(entries: DataFrame, policy: str = CURRENT, rules=RULES) -> DataFrame:
    """Per rule of a policy: rows failing it, rows failing it alone, and rows kept if it were left out."""
    mask = mask_of(POLICIES[policy])
    # The ledger is first summed by its distinct bit patterns, at most 2**rules of them.
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    parts = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.col("bits").bitwiseAND(F.lit(1 << r.bit)).alias("hit"),
            F.col("bits").bitwiseAND(F.lit(mask & ~(1 << r.bit))).alias("rest"),
        )
        for r in rules
        if mask >> r.bit & 1
    ]
    return (
        patterns.select("n", F.explode(F.array(*parts)).alias("r"))
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("r.hit") != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when((F.col("r.hit") != 0) & (F.col("r.rest") == 0), F.col("n")).otherwise(0)).alias("failing_alone"),
            F.sum(F.when(F.col("r.rest") == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )


def apply_policy(docs: DataFrame, policy: str = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass a policy, with all their columns; each row is judged by its own text."""
    from .selection import keep_numbered, with_ids, with_rows

    rows = with_rows(docs)
    entries = ledger(with_ids(rows, id_col, text_col), "id", "text")
    return keep_numbered(rows, entries.select("doc_id.row", passes(policy).alias("kept")))
