"""Column functions for samples and labels."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Fixed values of the front end whose words these are: bits, tags that mark a valid sample, millivolts for a count.
WORD_BITS, VALID_TAGS = 24, (0, 1, 2)
MV_PER_COUNT = 1000.0 / ((1 << 17) * 20)
#: A sentinel that stands for a missing sample.
MISSING = -99.0


def valid(v: Column) -> Column:
    """v without what is not a number, infinite or the sentinel."""
    bad = F.isnan(v) | (F.abs(v) == float("inf")) | (v == MISSING)
    return F.when(bad, None).otherwise(v)


def decode_word(raw: Column) -> Column:
    """Millivolts of a 24-bit word: 18 bits of signed sample over 3 bits of tag and 3 unused; null for other tags."""
    u = raw.bitwiseAND((1 << WORD_BITS) - 1)
    tag = F.shiftright(u, 3).bitwiseAND(7)
    signed = F.when(u >= 1 << (WORD_BITS - 1), u - (1 << WORD_BITS)).otherwise(u)
    return F.when(tag.isin(*VALID_TAGS), F.floor(signed / 64) * MV_PER_COUNT)


def z_score(v: Column, w: WindowSpec, guard: float = 1e-6) -> Column:
    sd = F.stddev_pop(v).over(w)
    return F.when(sd > guard, (v - F.avg(v).over(w)) / sd).otherwise(v - F.avg(v).over(w))


def min_max(v: Column, w: WindowSpec) -> Column:
    lo, hi = F.min(v).over(w), F.max(v).over(w)
    return F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(F.lit(0.0))


def heart_rate(rr_ms: Column) -> Column:
    return 60000.0 / rr_ms


def is_dose(label: Column) -> Column:
    return label.rlike("(?i)medication intake|drug")


def first_number(label: Column) -> Column:
    return F.regexp_extract(label, r"(\d+)", 1).try_cast("int")


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def fixed_time(text: Column) -> Column:
    """A timestamp in any of the four layouts of recording headers."""
    layouts = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd.MM.yyyy HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(x)) for x in layouts])
