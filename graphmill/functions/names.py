"""Predicates on identifiers, import specifiers and paths, as columns and for plain strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Primitive type names of the analysed language (sized integers follow a rule, see below).
PRIMITIVE_TYPES = (
    "anyerror", "anyframe", "anyopaque", "bool", "c_char", "c_int", "c_long", "c_longdouble", "c_longlong", "c_short", "c_uint",
    "c_ulong", "c_ulonglong", "c_ushort", "comptime_float", "comptime_int", "f128", "f16", "f32", "f64", "f80", "i16", "i32", "i64",
    "i8", "isize", "noreturn", "type", "u16", "u32", "u64", "u8", "usize", "void",
)
#: Primitive value names.
PRIMITIVE_VALUES = ("false", "null", "true", "undefined")
#: Modules that are always outside a project.
BUILT_IN_MODULES = ("builtin", "root", "std")
#: Accessors of standard containers that hand out an element.
PAYLOAD_ACCESSORS = (
    "addOne", "addOneAssumeCapacity", "at", "fetchOrderedRemove", "fetchPut", "fetchRemove", "fetchSwapRemove", "get", "getLast",
    "getLastOrNull", "getOrPut", "getOrPutValue", "getPtr", "items", "iterator", "orderedRemove", "pop", "popOrNull", "slice",
    "swapRemove", "valueIterator", "valuePtr", "values",
)
#: Fields that carry an element through an iterator or entry.
PAYLOAD_CARRIERS = ("items", "key_ptr", "next", "value", "value_ptr")
_SIZED = re.compile(r"[iu][0-9]+\Z")


def primitive_type(name: str) -> bool:
    """A primitive type; integers of any width count when the name is longer than two characters."""
    return name in PRIMITIVE_TYPES or (len(name) > 2 and _SIZED.match(name) is not None)


def primitive_value(name: str) -> bool:
    return name in PRIMITIVE_VALUES


def is_primitive_type(name: Column) -> Column:
    return name.isin(*PRIMITIVE_TYPES) | ((F.octet_length(name) > 2) & name.rlike("^[iu][0-9]+$"))


def is_primitive_value(name: Column) -> Column:
    return name.isin(*PRIMITIVE_VALUES)


def import_kind(specifier: str) -> str:
    """``file`` when the last dot is neither the first nor the last character, else ``module``."""
    at = specifier.rfind(".")
    return "file" if 0 < at < len(specifier) - 1 else "module"


def import_kind_of(specifier: Column) -> Column:
    after = F.octet_length(F.substring_index(specifier, ".", -1))
    whole = F.octet_length(specifier)
    return F.when(specifier.contains(".") & (after > 0) & (after < whole - 1), "file").otherwise("module")


def under(path: Column, directory: Column) -> Column:
    """The path lies in the directory (a prefix, then a separator)."""
    return path.startswith(F.concat(directory, F.lit("/")))


def skipped_path(path: str) -> bool:
    """A path that source discovery leaves out: a dot component, or a cache, output or vendor folder."""
    return any((p.startswith(".") and len(p) > 1) or p in ("zig-cache", "zig-out", "vendor") for p in path.split("/"))
