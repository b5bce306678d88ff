"""Rule predicates as Columns with two-valued logic: a missing value never makes the result null."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    octets = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))
    valid = (F.size(octets) == 4) & F.forall(octets, lambda x: x.between(0, 255))
    return F.when(valid, F.aggregate(octets, F.lit(0).cast("long"), lambda n, x: n * 256 + x))


def cidr_range(cidr: str) -> tuple[int, int]:
    """First and last address of an IPv4 block."""
    base, _, bits = cidr.partition("/")
    a, b, c, d = map(int, base.split("."))
    size = 1 << (32 - int(bits or 32))
    low = (a << 24 | b << 16 | c << 8 | d) // size * size
    return low, low + size - 1


def ip6_digits(ip: Column) -> Column:
    """An IPv6 address as its 32 hexadecimal digits, which sort as the addresses do; null if it is none. Embedded IPv4 is not read."""
    sides = F.split(F.lower(ip), "::")
    groups = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))
    left, right = groups(F.get(sides, F.lit(0))), F.coalesce(groups(F.get(sides, F.lit(1))), F.array().cast("array<string>"))
    lacking = F.lit(8) - F.size(left) - F.size(right)
    whole = F.when(F.size(sides) == 1, lacking == 0).otherwise((F.size(sides) == 2) & (lacking > 0))
    plain = F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    padded = lambda side: F.array_join(F.transform(side, lambda g: F.lpad(g, 4, "0")), "")
    return F.when(whole & plain, F.concat(padded(left), F.repeat(F.lit("0000"), F.greatest(lacking, F.lit(0))), padded(right)))


def cidr6_digits(cidr: str) -> tuple[str, str]:
    """First and last address of an IPv6 block, as digits."""
    block = ipaddress.IPv6Network(cidr, strict=False)
    return f"{int(block[0]):032x}", f"{int(block[-1]):032x}"


def address_digits(ip: Column) -> Column:
    """The kind of an address, 4 or 6, and its hexadecimal digits; null if it is none."""
    n = ip_number(ip)
    return F.coalesce(F.when(n.isNotNull(), F.concat(F.lit("4"), F.lower(F.lpad(F.hex(n), 8, "0")))), F.concat(F.lit("6"), ip6_digits(ip)))


def block_digits(cidr: Column) -> Column:
    """The beginnings that the digits of a block's addresses have, as address_digits gives them: eight at most; null if it is no block."""
    digits = address_digits(F.substring_index(cidr, "/", 1))
    most = F.when(digits.startswith("4"), 32).otherwise(128)
    bits = F.when(cidr.contains("/"), F.substring_index(cidr, "/", -1).try_cast("int")).otherwise(most)
    whole = F.ceil(bits / 4).cast("int")
    wide = F.pow(F.lit(2), whole * 4 - bits).cast("int")
    last = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    ends = F.transform(F.sequence(F.lit(0), wide - 1), lambda i: F.concat(F.substr(digits, F.lit(1), whole), F.lower(F.hex(last - last % wide + i))))
    return F.when(digits.isNotNull() & bits.between(0, most), F.when(whole == 0, F.array(F.substr(digits, F.lit(1), F.lit(1)))).otherwise(ends))


def in_cidr(ip: Column, cidr: str) -> Column:
    """Whether an address lies in a block of its own kind."""
    if ":" in cidr:
        return _sure(ip6_digits(ip).between(*map(F.lit, cidr6_digits(cidr))))
    return _sure(ip_number(ip).between(*cidr_range(cidr)))


def _is_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")).isin("", "0", "0.0", "false", "[]")


def _items(c: Column, is_array: bool) -> Column:
    return c if is_array else F.array(c)


#: Operator name to a function of the column, the value and whether the column is an array.
OPERATORS: dict[str, Callable] = {
    "eq": lambda c, v, _: c.eqNullSafe(F.lit(v)),
    "ne": lambda c, v, _: ~c.eqNullSafe(F.lit(v)),
    "gt": lambda c, v, _: _sure(c > F.lit(v)),
    "gte": lambda c, v, _: _sure(c >= F.lit(v)),
    "lt": lambda c, v, _: _sure(c < F.lit(v)),
    "lte": lambda c, v, _: _sure(c <= F.lit(v)),
    "contains": lambda c, v, a: _sure(F.array_contains(c, v)) if a else _text(c).contains(v),
    "not_contains": lambda c, v, a: ~(_sure(F.array_contains(c, v)) if a else _text(c).contains(v)),
    "startswith": lambda c, v, _: _text(c).startswith(v),
    "endswith": lambda c, v, _: _text(c).endswith(v),
    "in": lambda c, v, _: _sure(c.isin(list(v))),
    "not_in": lambda c, v, _: ~_sure(c.isin(list(v))),
    "regex": lambda c, v, _: _text(c).rlike(v),
    "exists": lambda c, v, _: c.isNotNull(),
    "not_exists": lambda c, v, _: c.isNull(),
    "is_empty": lambda c, v, _: _is_empty(c),
    "is_not_empty": lambda c, v, _: ~_is_empty(c),
    "between": lambda c, v, _: _sure(c.between(*v)),
    "cidr": lambda c, v, _: in_cidr(c, v),
    "any_in": lambda c, v, a: _sure(F.arrays_overlap(_items(c, a), F.array(*map(F.lit, v)))),
    "all_in": lambda c, v, a: F.size(F.array_except(F.coalesce(_items(c, a), F.array().cast("array<string>")), F.array(*map(F.lit, v)))) == 0,
}


def predicate(name: str, operator: str, value=None, case_sensitive: bool = True, is_array: bool = False) -> Column:
    """A condition on a field. Without case, both sides are lowered if both are text."""
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}; one of {', '.join(OPERATORS)}")
    column = F.col(name)
    if not case_sensitive and isinstance(value, str):
        column, value = F.lower(column), value.lower()
    return OPERATORS[operator](column, value, is_array)
