"""Column functions: hash draws, text clean-up, predictability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: str | int | Column) -> Column:
    """A number in (0, 1) that depends on the parts alone: the same on every run, whatever the partitioning."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")
    return (h.cast("double") + 1) / F.lit(4294967297.0)


def uniform_sql(*parts: str) -> str:
    """The same in DuckDB; parts are SQL expressions."""
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((('0x' || substr(md5(concat_ws('|', {text})), 1, 8))::UBIGINT::DOUBLE + 1) / 4294967297.0)"


def year_of(c: Column) -> Column:
    return F.split(c, "-")[0]


def last_part(c: Column, separator: str) -> Column:
    return F.element_at(F.split(c, separator), -1)


def cut_brackets(c: Column) -> Column:
    """Up to the first `[` and `(`, without blanks, brackets and dots at the ends."""
    return F.btrim(F.substring_index(F.substring_index(c, "[", 1), "(", 1), F.lit(" )([]."))


def last_number(c: Column) -> Column:
    return F.element_at(F.split(c, "\\D+"), -1).try_cast("int")


def prior_predictability(p: Column, prior: Column) -> Column:
    """How far p is from its prior, in [0, 1] on either side."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return clip(F.coalesce(F.try_divide(p - prior, 1 - prior), F.lit(0.0))) + clip(F.coalesce(F.try_divide(prior - p, prior), F.lit(0.0)))


def kl_predictability(probs: Column, priors: Column) -> Column:
    """1 - exp(-KL(p || prior)) of two arrays."""
    terms = F.zip_with(probs, priors, lambda p, q: F.when(p > 0, p * F.ln(p / q)).otherwise(F.lit(0.0)))
    return 1 - F.exp(-F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def percentile_mix(p: Column, prior: Column, is_value: Column, q: Column, s: Column, others: Column) -> Column:
    """A probability mixed with one that has quantile q of belief in a value; `others`: how many values there are beside it."""
    up = prior + (q - 0.5) / 0.5 * (1 - prior)
    down = prior - (0.5 - q) / 0.5 * prior
    on = F.when(q > 0.5, up).otherwise(down)
    return p * s + (1 - s) * F.when(is_value, on).otherwise((1 - on) / others)


def discretize(c: Column, low: Column, high: Column, steps: int) -> Column:
    """Equal-width bins of [low, high] in [0, 1]."""
    return F.ceil(F.try_divide(c - low, high - low) * (steps - 1)) / F.lit(float(steps - 1))


def factors(c: Column, base: int) -> tuple[Column, Column]:
    """A code of a large domain as two of smaller ones: quotient and remainder."""
    return F.floor(c / base).cast("long"), F.pmod(c, F.lit(base))


def factored(quotient: Column, remainder: Column, base: int) -> Column:
    return quotient * base + remainder


def to_datetime(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Text as a timestamp; null where it isn't one."""
    return F.try_to_timestamp(c, F.lit(pattern))


def standard_score(c: Column, mean: Column, deviation: Column) -> Column:
    return F.coalesce(F.try_divide(F.coalesce(c, mean) - mean, deviation), F.lit(0.0))
