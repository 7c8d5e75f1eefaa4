"""Bit-set algebra on integer flag columns, and the flag sets of symbols, scopes and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flag names in bit order, bit 0 first.
SYMBOL_FLAGS = ("variable", "payload", "comptime", "extern", "export", "const", "member", "fn", "fn_param", "catch_param", "error", "struct", "enum", "union")
SCOPE_FLAGS = ("top", "function", "struct", "enum", "union", "error", "block", "comptime", "catch", "test")
REFERENCE_FLAGS = ("read", "write", "call", "type", "member", "primitive")


def bits(flags: set[str] | frozenset[str], names: tuple[str, ...]) -> int:
    return sum(1 << names.index(f) for f in flags)


def merge(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def intersects(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b) != 0


def contains(a: Column, b: Column) -> Column:
    """Every flag of b is in a."""
    return a.bitwiseAND(b) == b


def is_empty(a: Column) -> Column:
    return a == 0


def invert(a: Column, width: int) -> Column:
    return a.bitwiseXOR(F.lit((1 << width) - 1))


def assign(a: Column, b: Column, on: Column) -> Column:
    """a with the flags of b set or cleared."""
    return F.when(on, a.bitwiseOR(b)).otherwise(a.bitwiseAND(F.bitwise_not(b)))


def names_of(a: Column, names: tuple[str, ...]) -> Column:
    """The set flags by name, in bit order."""
    return F.filter(F.array(*[F.when(a.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())


def to_json(a: Column, names: tuple[str, ...]) -> Column:
    """The set flags as a JSON array of names, in bit order."""
    return F.to_json(names_of(a, names))


def member_use(flags: Column, use: str) -> Column:
    """A reference with this use (read, write, call, type) through a member access."""
    return contains(flags, F.lit(bits({use, "member"}, REFERENCE_FLAGS)))


def self_use(flags: Column, use: str) -> Column:
    """A reference with this use that is no member access."""
    return intersects(flags, F.lit(bits({use}, REFERENCE_FLAGS))) & ~intersects(flags, F.lit(bits({"member"}, REFERENCE_FLAGS)))
