"""Vaults: notes with their text, all tracked files, and the tables derived from their paths."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.functions.paths import parent, stem
from inkmesh.session import read_table

# Fixed value: path prefixes a link scan leaves out unless told otherwise.
SCAN_EXCLUDES = ("50-diary/", "60-archive/", "30-reference/references/bookmarks/archive/")


def _own_folder(name: str) -> bool:
    """Folders that tools keep for themselves, never part of a vault on disk."""
    return name == ".trash" or (name.startswith(".") and name.endswith("-backup"))


@dataclass
class Vault:
    """``notes`` (path, text) and ``files`` (path) with one row per path."""

    notes: DataFrame
    files: DataFrame

    @cached_property
    def dirs(self) -> DataFrame:
        """Every ancestor folder of a file, without trailing slash, the root left out."""
        parts = F.split("path", "/")
        ends = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: k < F.size(parts))
        up = F.transform(ends, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
        return self.files.select(F.explode(up).alias("dir")).distinct()

    @cached_property
    def stems(self) -> DataFrame:
        """(stem, winner, candidates, n): the last path wins."""
        return self.notes.groupBy(stem(F.col("path")).alias("stem")).agg(
            F.max("path").alias("winner"), F.sort_array(F.collect_set("path")).alias("candidates"), F.countDistinct("path").alias("n")
        )

    @cached_property
    def by_parent(self) -> DataFrame:
        return self.notes.groupBy(parent(F.col("path")).alias("dir")).agg(F.sort_array(F.collect_list("path")).alias("paths"))

    def scanned(self, exclude: tuple[str, ...] | None = None) -> DataFrame:
        """Notes without those under excluded prefixes."""
        out = self.notes
        for p in SCAN_EXCLUDES if exclude is None else exclude:
            out = out.where(~F.col("path").startswith(p))
        return out

    def cache(self) -> Vault:
        return Vault(self.notes.cache(), self.files.cache())


def vault_root(value: str | Path | None = None) -> Path:
    """Root from an argument, the environment or the default, '~' expanded."""
    return Path(value or os.environ.get("INKMESH_ROOT") or "~/code/knowledge").expanduser()


def tracked_files(root: str | Path, pattern: str | None = None) -> list[str]:
    """Paths git tracks, in byte order, once each."""
    cmd = ["git", "-C", str(root), "ls-files", "-z", *([pattern] if pattern else [])]
    return sorted({p for p in subprocess.check_output(cmd, text=True).split("\0") if p.strip()})


def notes_on_disk(root: str | Path) -> list[str]:
    """Markdown files below a folder, tracked or not, sorted by path components."""
    base = Path(root)
    found = (p.relative_to(base) for p in base.rglob("*.md"))
    return [p.as_posix() for p in sorted(found) if not any(map(_own_folder, p.parts[:-1]))]


def decode(strict: bool, name: str = "content") -> Column:
    """Bytes as text: invalid ones raise if strict, else are left out."""
    if strict:
        return F.validate_utf8(F.col(name).cast("string"))

    @F.udf("string", useArrow=True)
    def lossy(b: bytes) -> str:
        return None if b is None else bytes(b).decode("utf-8", "ignore")

    return F.when(F.is_valid_utf8(F.col(name).cast("string")), F.col(name).cast("string")).otherwise(lossy(F.col(name)))


def read_texts(spark: SparkSession, root: str | Path, paths: list[str], strict: bool = False) -> DataFrame:
    """(path, text) of files below a root, in parallel; missing files are left out.

    Files are named one by one as a listing would skip names that begin with '.' or '_'.
    """
    base = str(root)
    parts = max(1, min(len(paths) // 256 + 1, 4096))
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(parts)

    def load(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    rows.append((p, (Path(base) / p).read_bytes()))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "content"])

    return listed.mapInPandas(load, "path string, content binary").select("path", decode(strict).alias("text"))


def from_git(spark: SparkSession, root: str | Path, prefix: str | None = None) -> Vault:
    """Vault of the files git tracks; ``prefix`` narrows the notes before they are read."""
    files = tracked_files(root)
    notes = [p for p in files if p.endswith(".md") and (prefix is None or p.startswith(prefix))]
    return Vault(read_texts(spark, root, notes), spark.createDataFrame([(p,) for p in files], "path string"))


def from_disk(spark: SparkSession, root: str | Path, strict: bool = True) -> Vault:
    notes = notes_on_disk(root)
    return Vault(read_texts(spark, root, notes, strict), spark.createDataFrame([(p,) for p in notes], "path string"))


def from_rows(spark: SparkSession, notes: dict[str, str], others: list[str] | None = None) -> Vault:
    """A small vault from a mapping of paths to texts and further files."""
    paths = [*notes, *(others or [])]
    return Vault(
        spark.createDataFrame(list(notes.items()), "path string, text string"), spark.createDataFrame([(p,) for p in paths], "path string")
    )


def from_tables(spark: SparkSession, sf_dir: str) -> Vault:
    """The living notes of the tables, each with the link tokens logged for it below its text."""
    raw = read_table(spark, sf_dir, "notes").where("deleted_at is null and path is not null")
    notes = raw.groupBy("path").agg(F.max_by("content", F.struct("created_at", "note_id")).alias("content"))
    wiki = F.concat(F.lit("[["), "raw", F.lit("]]"))
    token = F.when(F.col("kind") == "wikilink", wiki).otherwise(F.concat(F.lit("[x]("), "raw", F.lit(")")))
    links = read_table(spark, sf_dir, "links").where("raw is not null and src is not null")
    each = links.groupBy("src").agg(F.sort_array(F.collect_set(F.struct("link_id", token.alias("t")))).alias("t"))
    tokens = each.select("src", F.array_join(F.transform("t", lambda x: x["t"]), "\n").alias("tokens"))
    text = F.concat(F.coalesce("content", F.lit("")), F.lit("\n"), F.coalesce("tokens", F.lit("")))
    full = notes.join(tokens, notes["path"] == tokens["src"], "left").select("path", text.alias("text"))
    shared = read_table(spark, sf_dir, "shared_files").where("deleted_at is null and path is not null").select("path")
    return Vault(full, notes.select("path").unionByName(shared).distinct())
