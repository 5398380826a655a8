"""Scalar rules of the sync wire: status classes, backoff, version order, mutation ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INITIAL_MS, MOST_MS = 1_000, 60_000


#: (least status, greatest, class), the first that fits; what is not known is worth a retry.
STATUSES = ((200, 299, "verdict"), (409, 409, "schema"), (408, 408, "transient"), (429, 429, "transient"), (400, 499, "permanent"))


def status_class(status: Column) -> Column:
    """'verdict', 'schema', 'transient' or 'permanent'."""
    return F.coalesce(*(F.when(status.between(low, high), name) for low, high, name in STATUSES), F.lit("transient"))


def class_of(status: int) -> str:
    """The same for one status."""
    return next((name for low, high, name in STATUSES if low <= status <= high), "transient")


def raises(outcome: Column) -> Column:
    return outcome != "verdict"


def backoff_limit(attempt: Column, initial: int = INITIAL_MS, most: int = MOST_MS) -> Column:
    doubled = F.lit(float(initial)) * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(attempt - 1, F.lit(64))))
    return F.least(F.lit(float(most)), doubled)


def backoff(attempt: Column, chance: Column | None = None, initial: int = INITIAL_MS, most: int = MOST_MS) -> Column:
    """Milliseconds to wait: the chance in [0, 1) of the whole exponential limit."""
    return F.floor((F.rand() if chance is None else chance) * backoff_limit(attempt, initial, most)).cast("long")


def version_number(version: Column) -> Column:
    """The number a version's text stands for, NULL if it stands for none. Blank text is 0; 0x, 0o and 0b have digits."""
    text = F.trim(version)
    based = [F.when(F.lower(text).rlike(rf"^0{mark}[{digits}]+$"), F.conv(F.substring(text, 3, 64), base, 10).cast("double")) for mark, digits, base in (("x", "0-9a-f", 16), ("o", "0-7", 8), ("b", "01", 2))]
    plain = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    number = F.coalesce(F.when(text == "", F.lit(0.0)), *based, plain)
    return F.when(F.abs(number) < float("inf"), number)


def compare_versions(a: Column, b: Column) -> Column:
    """'newer', 'same' or 'older', of a against b: as numbers if both are, else as texts by code unit."""
    x, y = version_number(a), version_number(b)
    p, q = (F.hex(F.encode(v, "UTF-16BE")) for v in (a, b))
    numeric = x.isNotNull() & y.isNotNull()
    pick = lambda same, more: F.when(same, "same").when(more, "newer").otherwise("older")
    return F.when(numeric, pick(x == y, x > y)).otherwise(pick(p == q, p > q))


def mutation_id(time: Column, counter: Column, client: Column) -> Column:
    return F.concat_ws("-", time.cast("string"), counter.cast("string"), client.cast("string"))
