"""Column functions: checks, sizes, names, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DELETE, MAX_KEY, MAX_VALUE, PUT

OK, INVALID, NOT_FOUND = "OK", "InvalidArgument", "NotFound"


def key_status(key: Column) -> Column:
    """Length counts in bytes. A null key is as bad as an empty one."""
    n = F.octet_length(key)
    return F.when(key.isNull() | (n == 0) | (n > MAX_KEY), F.lit(INVALID)).otherwise(F.lit(OK))


def value_status(value: Column) -> Column:
    return F.when(F.octet_length(value) > MAX_VALUE, F.lit(INVALID)).otherwise(F.lit(OK))


def applied(kind: Column, value: Column) -> Column:
    """The value that a mutation leaves: its own, null for a tombstone; any other type is an error."""
    return F.when(kind == PUT, value).when(kind == DELETE, F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("unknown mutation type "), F.coalesce(kind, F.lit("null")))))


def record_size(key: Column, value: Column) -> Column:
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + 8).cast("long")


def number_in(name: Column, prefix: str, suffix: str = "") -> Column:
    """The number in names like prefix<n>suffix; null for other names. A name of that form whose number can't be read is an
    error; what ends in .tmp is not yet committed and no such name."""
    middle = F.substring(name, F.lit(len(prefix) + 1), F.length(name) - len(prefix + suffix))
    ours = name.startswith(prefix) & name.endswith(suffix) & ~name.endswith(".tmp") & (F.length(name) >= len(prefix + suffix))
    bad = F.raise_error(F.concat(F.lit("no number in the name "), name)).cast("long")
    return F.when(ours, F.when(middle.rlike("^[0-9]{1,18}$"), middle.cast("long")).otherwise(bad))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading characters that both share, by halving: a comparison for each bit of the number."""
    n = F.least(F.length(a), F.length(b))
    longer = lambda k, bit: F.when((k + bit <= n) & (F.substring(a, F.lit(1), k + bit) == F.substring(b, F.lit(1), k + bit)), k + bit).otherwise(k)
    return F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(MAX_KEY.bit_length()))]), F.lit(0), longer)
