"""Quality rules as a bitmask ledger (DataFrame and SQL functions only).

``measure`` computes every measurement of a text once. ``ledger`` evaluates every rule once and
stores one failure bit per rule beside the measurements. Policies are versioned sets of rules,
applied to stored bits; ablations count, from the same bits, what each rule alone removes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``failed`` is SQL over the measurements; ``bit`` is the rule's fixed position in every ledger."""

    name: str
    bit: int
    failed: str


@dataclass(frozen=True)
class Policy:
    """A version names the rules that count; old ledgers can be re-judged under any version."""

    version: str
    rules: tuple[str, ...]


#: Bits are never reused or renumbered. Ratios are written as products of integers, so ties at a
#: limit are exact.
RULES = (
    Rule("too_few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 3 * n_words"),
    Rule("shouting", 3, "2 * n_upper > word_chars and n_words > 0"),
    Rule("duplicate_lines", 4, "2 * n_dup_lines > n_word_lines and n_word_lines > 0"),
    Rule("long_words", 5, "word_chars > 25 * n_words"),
)
BASE = Policy("base", ("too_few_words", "repeated_words"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", tuple(r.name for r in RULES)))}


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add long columns n_words, word_chars, n_symbols, n_upper, n_word_lines, n_dup_lines and n_repeat_words.

    Words are runs of characters other than space and U+0009-U+000D. A null text counts as empty
    and all its measurements are 0. n_repeat_words counts the words that lie in at least one
    three-word window found twice or more in the text; windows are told apart by 64-bit hashes
    within the one text. Columns of the input with these names are
    replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_upper", "n_word_lines", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in df.columns if c not in [*names, "flat_", "words_", "lines_", "hashed_", "placed_", "pairs_"]]
    full = F.coalesce(F.col(text), F.lit(""))
    length = lambda c: F.char_length(c).cast("long")
    # Literal replacements and a split at one character run without the regex engine.
    flat = reduce(lambda c, space: F.replace(c, F.lit(space), F.lit(" ")), SPACES[1:], full)
    out = df.select("*", flat.alias("flat_"))
    out = out.select(
        *kept,
        "flat_",
        F.array_remove(F.split("flat_", " "), "").alias("words_"),
        F.filter(F.split(full, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("lines_"),
    )
    without_symbols = reduce(lambda c, symbol: F.replace(c, F.lit(symbol), F.lit("")), SYMBOLS, F.col("flat_"))
    n = F.size("words_")
    third = lambda k: F.slice("words_", F.lit(k), n - 2)
    hashed = F.zip_with(F.zip_with(third(1), third(2), lambda a, b: F.xxhash64(a, b)), third(3), lambda h, c: F.xxhash64(h, c))
    out = out.withColumn("hashed_", F.when(n >= 3, hashed))
    # Distinct hashes prove that no window repeats; only otherwise windows are sorted with their places.
    # Each step is a column of its own, so that nothing is evaluated twice.
    placed = F.sort_array(F.transform("hashed_", lambda h, i: F.struct(h.alias("w"), i.cast("long").alias("i"))))
    out = out.withColumn("placed_", F.when(F.size(F.array_distinct("hashed_")) < n - 2, placed))
    out = out.withColumn("pairs_", F.zip_with("placed_", F.slice("placed_", F.lit(2), F.size("placed_")), _equal_neighbours))
    repeats = F.coalesce(_covered(F.col("pairs_")), F.lit(0)).cast("long")
    return out.select(
        *kept,
        n.cast("long").alias("n_words"),
        length(F.replace("flat_", F.lit(" "), F.lit(""))).alias("word_chars"),
        (length(F.col("flat_")) - length(without_symbols)).alias("n_symbols"),
        (length(F.col("flat_")) - length(F.regexp_replace("flat_", r"\p{Lu}+", ""))).alias("n_upper"),
        F.size("lines_").cast("long").alias("n_word_lines"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
    )


def _equal_neighbours(one: Column, other: Column) -> Column:
    """The places of two windows next to each other in sorted order if they are equal, else null."""
    return F.when(one["w"] == other["w"], F.array(one["i"], other["i"]))


def _covered(pairs: Column) -> Column:
    """Words under the windows at the given places: each adds its three words less those its predecessor covers."""
    places = F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    step = lambda acc, at: F.struct((acc["n"] + F.least(F.lit(3).cast("long"), at - acc["last"])).alias("n"), at.alias("last"))
    return F.aggregate(places, zero, step, lambda acc: acc["n"])


def ledger(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``failures``: bit ``rule.bit`` is set where the rule failed."""
    bits = [F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("failures", total)


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bit = {r.name: r.bit for r in rules}
    return sum(1 << bit[name] for name in policy.rules)


def passes(policy: Policy, failures: str = "failures", rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the policy failed."""
    return F.col(failures).bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablations(ledgers: DataFrame, policies: dict[str, Policy] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: ``failed``, ``failed_alone`` (documents that dropping the rule brings back) and ``kept`` by the policy.

    Works on the histogram of distinct bitmasks, at most 2^rules rows whatever the corpus.
    """
    spark = ledgers.sparkSession
    histogram = ledgers.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    bit = {r.name: r.bit for r in rules}
    grid = spark.createDataFrame(
        [(p.version, name, 1 << bit[name], mask(p, rules)) for p in policies.values() for name in p.rules],
        "policy string, rule string, rule_mask long, policy_mask long",
    )
    hit = F.col("failures").bitwiseAND(F.col("policy_mask"))
    return (
        histogram.crossJoin(F.broadcast(grid))
        .groupBy("policy", "rule")
        .agg(
            F.coalesce(F.sum(F.when(hit.bitwiseAND(F.col("rule_mask")) != 0, F.col("n"))), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(hit == F.col("rule_mask"), F.col("n"))), F.lit(0)).alias("failed_alone"),
            F.coalesce(F.sum(F.when(hit == 0, F.col("n"))), F.lit(0)).alias("kept"),
        )
    )
