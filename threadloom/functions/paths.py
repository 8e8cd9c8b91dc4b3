"""Boundaries of file paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import INDEX_STEMS


def _slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def parent_dir(path: Column) -> Column:
    """'a/b.py' -> 'a'; without a slash: empty."""
    return F.regexp_extract(_slashes(path), r"(?s)^(.*)/[^/]*$", 1)


def boundary(path: Column, granularity: str = "module") -> Column:
    """The module, directory or file that a path belongs to.

    A module is the path without its last extension; files named mod, lib, main, index or __init__ stand for their
    directory. Anything but file, dir and directory means module.
    """
    g = granularity.lower()
    if g == "file":
        return _slashes(path)
    d = parent_dir(path)
    if g in ("dir", "directory"):
        return F.when(F.instr(_slashes(path), "/") == 0, F.lit(".")).otherwise(d)
    stem = F.regexp_replace(F.regexp_extract(_slashes(path), r"(?s)([^/]*)$", 1), r"(?s)^(.+)\.[^.]*$", "$1")
    return F.when(stem.isin(*INDEX_STEMS), F.when(d == "", stem).otherwise(d)).when(d == "", stem).otherwise(F.concat(d, F.lit("/"), stem))


def distance(a: Column, b: Column) -> Column:
    """1: same parent directory; 2: same first segment; 3: otherwise."""
    first = lambda x: F.substring_index(x, "/", 1)
    up = lambda x: F.when(F.instr(x, "/") == 0, F.lit(".")).otherwise(parent_dir(x))
    return F.when(up(a) == up(b), 1).when(first(a) == first(b), 2).otherwise(3)
