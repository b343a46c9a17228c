"""Path expressions over '/'-separated relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent(p: Column) -> Column:
    """Folder of a path, '' at the root."""
    return F.left(p, F.greatest(F.length(p) - F.length(basename(p)) - 1, F.lit(0)))


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def stem(p: Column) -> Column:
    """Name without its last suffix; a leading dot is part of the name."""
    return F.regexp_replace(basename(p), r"(?<=.)\.[^.]+$", "")


def top_dir(p: Column, at_root: Column) -> Column:
    return F.when(F.contains(p, F.lit("/")), F.substring_index(p, "/", 1)).otherwise(at_root)


def normpath(p: Column) -> Column:
    """POSIX normalisation; the fold runs only where a segment needs it."""

    def step(acc: Column, x: Column) -> Column:
        back = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return (
            F.when(x.isin("", "."), acc)
            .when((x == "..") & back, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .otherwise(F.array_append(acc, x))
        )

    folded = F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
    slow = F.when(folded == "", F.lit(".")).otherwise(folded)
    odd = p.isin("", ".", "..") | p.startswith("/")
    for part in ("//", "./"):
        odd = odd | F.contains(p, F.lit(part))
    for end in ("/", "/.", "/.."):
        odd = odd | p.endswith(end)
    return F.when(odd, slow).otherwise(p)


def beside(folder: Column, p: Column) -> Column:
    """A path as seen from a folder, not yet normalised."""
    return F.concat_ws("/", F.when(folder != "", folder), p)


def join_path(folder: Column, p: Column) -> Column:
    return normpath(beside(folder, p))
