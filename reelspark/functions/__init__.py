"""Column functions in the integer arithmetic that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Value = Column | str | int | float | bool | None


def col(x: Value) -> Column:
    """A column of that name, or a literal."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def idiv(a: Value, b: Value) -> Column:
    """Integer quotient, cut off towards zero."""
    return F.call_function("div", col(a), col(b))


def clamp(v: Value, low: Value, high: Value) -> Column:
    return F.least(col(high), F.greatest(col(low), col(v)))


def byte(v: Value) -> Column:
    return clamp(v, 0, 255)


def half_away(total: Value, n: Value) -> Column:
    """total / n as an integer, halves away from zero."""
    total, half = col(total), idiv(n, 2)
    return F.when(total >= 0, idiv(total + half, n)).otherwise(-idiv(half - total, n))


def up_to_multiple(n: Value, a: Value) -> Column:
    """The next multiple of a, n itself if it is one."""
    return idiv(col(n) + col(a) - 1, a) * col(a)


def round_to_multiple(n: Value, a: Value, least: Value = None) -> Column:
    """The nearest multiple of a, halves up, not below least (a itself by default); for a of one or less, n not below one or least."""
    n, a = col(n), F.greatest(F.lit(1), col(a))
    least = a if least is None else col(least)
    return F.when(n <= 0, least).otherwise(F.greatest(least, idiv(n + idiv(a, 2), a) * a))


def lookup(table: Mapping, key: Value, otherwise: Value = None) -> Column:
    """What a small fixed table says of a key."""
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[col(key)]
    return found if otherwise is None else F.coalesce(found, col(otherwise))


def pick(entries: Sequence[Column] | Column, at: Value) -> Column:
    """The entry at a place that counts from zero."""
    return F.get(entries if isinstance(entries, Column) else F.array(*entries), col(at))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body and the optimizer repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def le_bytes(v: Value, n: int) -> Column:
    """The n low bytes of an integer, the lowest first, as hexadecimal digits."""
    return F.format_string("%02x" * n, *[F.shiftright(col(v).cast("long"), 8 * k).bitwiseAND(255) for k in range(n)])


def le_int(data: Value, at: int, n: int) -> Column:
    """The integer in n bytes of a binary from byte at on, the lowest first; null where the data end before."""
    data = col(data)
    bytes_ = [F.conv(F.hex(F.substring(data, at + k + 1, 1)), 16, 10).cast("long") * (1 << 8 * k) for k in range(n)]
    return F.when(F.octet_length(data) >= at + n, sum(bytes_[1:], bytes_[0]))


def ascii_at(data: Value, at: int, n: int, backwards: bool = False) -> Column:
    """n bytes of a binary as ASCII text; null where one of them isn't, or the data end before."""
    order = range(n - 1, -1, -1) if backwards else range(n)
    text = F.concat(*[F.chr(le_int(data, at + k, 1)) for k in order])
    fine = [le_int(data, at + k, 1) < 128 for k in range(n)]
    return F.when(sum((x.cast("int") for x in fine[1:]), fine[0].cast("int")) == n, text)


def unused(df: DataFrame, name: str) -> str:
    """A column name like this that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
