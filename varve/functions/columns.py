"""Scalar, aggregate and window expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def slugify(text: Column) -> Column:
    """Runs of other characters become ``_``; one leading and one trailing ``_`` are stripped."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_|_$", "")


def slugify_strict(text: Column, empty: str = "item") -> Column:
    out = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", empty).otherwise(out)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("--", F.least(a, b), F.greatest(a, b))


def age_in_text(text: Column) -> Column:
    """The number before ``kya``, or null."""
    return F.nullif(F.regexp_extract(F.lower(text), r"(\d+(?:\.\d+)?)\s*kya", 1), F.lit("")).cast("double")


# Phrases of the intents, in the order in which they are tried.
INTENTS = {
    "seeding": ["seed", "top 100 taxa", "similar to core", "what taxa would i need"],
    "functional": ["functional capabilities", "what are the top functional", "how might they work"],
    "transition": ["glacial", "interglacial", "transition"],
}


def intent(text: Column) -> Column:
    """The first intent one of whose phrases the lower-cased text holds, else ``general``."""
    q, out = F.lower(text), None
    for name, phrases in INTENTS.items():
        held = F.greatest(*[F.instr(q, p) for p in phrases], F.lit(0)) > 0
        out = F.when(held, name) if out is None else out.when(held, name)
    return out.otherwise("general")


def truncate(text: Column, n: int) -> Column:
    """A null text becomes an empty one."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(F.coalesce(text, F.lit("")))


def prevalence_label(threshold: Column) -> Column:
    return F.concat(F.lit("prev_"), threshold.cast("int").cast("string"))


def fixed(x: Column, digits: int) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", x), F.lit("NA"))


def average_rank(value: str, partition: list[str]) -> Column:
    """Ranks from 1; ties share their mean rank."""
    w = Window.partitionBy(*partition)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, value))
    return F.rank().over(w.orderBy(value)) + (ties - 1) / 2


def minmax(x: Column, w: WindowSpec, constant: float = 0.0) -> Column:
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high == low, constant).otherwise((x - low) / (high - low))


def zscore(x: Column, w: WindowSpec) -> Column:
    """0 where the group is constant or has one row."""
    return F.coalesce(F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w)), F.lit(0.0))


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation of complete pairs; null below three pairs or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when(F.count(a) >= 3, F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)))


def row_mean(*columns: str) -> Column:
    """Mean of the non-null values of a row; null if there is none."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.try_divide(total, sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def log_ratio(a: Column, b: Column) -> Column:
    """ln of a ratio with an adaptive pseudocount: half the value, or 1e-6 where it is not positive."""
    extra = lambda x: F.when(x > 0, x / 2).otherwise(1e-6)
    return F.log((a + extra(a)) / (b + extra(b)))


def entropy(share: str) -> Column:
    """Shannon entropy of the positive shares of a group."""
    return -F.sum(F.when(F.col(share) > 0, F.col(share) * F.log(share)).otherwise(0.0))


def rounded(x: Column, digits: int) -> Column:
    """``x`` as SQL engines round doubles: the product with 10^digits is rounded, so halves that a quotient of counts reaches fall as theirs do.

    Spark's own ``round`` takes the shortest decimal form of the double, which reads as a half also where the double is below it.
    It also drops the sign of what rounds to zero, which SQL keeps (-0.0).
    """
    scaled = x * 10.0**digits
    return F.signum(scaled) * F.round(F.abs(scaled)) / 10.0**digits


def n_rows() -> Column:
    return F.count(F.lit(1))
