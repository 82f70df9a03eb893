"""Scalars: content hash, paths, whole words, sizes."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 64-bit hash of file contents. The basis is one digit short of the usual one, and must stay so for equal hashes.
HASH_BASIS, HASH_PRIME = 1469598103934665603, 1099511628211
_MASK = (1 << 64) - 1


def content_hash(data: bytes) -> int:
    """FNV-1a with the basis above, as the signed 64-bit number that a LONG column holds."""
    h = HASH_BASIS
    for byte in data:
        h = ((h ^ byte) * HASH_PRIME) & _MASK
    return h - (1 << 64) if h >> 63 else h


def unsigned(h: int) -> int:
    return h & _MASK


def normal_path(path: str) -> str:
    """Lexically normal, with forward slashes; a normal empty path is empty."""
    return posixpath.normpath(path) if path else ""


def include_target(includer: str, target: str) -> str:
    """Where a local include points: beside the includer, unless the target is absolute."""
    return normal_path(posixpath.join(posixpath.dirname(includer), target))


def c_source(path: Column) -> Column:
    """True where path ends in .c or .h."""
    return F.coalesce(path.endswith(".c") | path.endswith(".h"), F.lit(False))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def whole_word(text: Column, symbol: str) -> Column:
    """True where symbol stands in text as a whole word (letters, digits and _ are word characters). An empty symbol never does."""
    if not symbol:
        return F.lit(False)
    return text.rlike(r"(?<![A-Za-z0-9_])" + re.escape(symbol) + r"(?![A-Za-z0-9_])")


def human_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024 or unit == "GiB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    raise AssertionError
