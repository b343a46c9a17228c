"""Guarded sink for redirect plans: transforms run in Spark, the few files of a commit are written on the driver.

A commit is all or nothing: every file is backed up once before any is written, writes are
atomic, results are verified, and whatever fails puts the originals back.
"""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import tempfile
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.operators import redirects, rewrite
from inkmesh.session import cut
from inkmesh.sources import vault as vaults

SCHEMA, VERSION = "inkmesh.apply/v1", "0.2.0"
#: Manifests of other tools with the same fields can be verified and rolled back too.
READABLE = "apply/v1"
BACKUPS, TRASH = ".inkmesh-backup", ".trash"
AFTER = ("keep", "redirect", "trash")


class PreflightError(ValueError):
    """Links that cannot be rewritten safely."""

    def __init__(self, issues: list[dict]) -> None:
        super().__init__(f"preflight found {len(issues)} issue(s)")
        self.issues = issues


def digest(path: Path) -> str | None:
    return hashlib.sha256(path.read_bytes()).hexdigest() if path.is_file() else None


def write_atomic(path: Path, data: bytes) -> None:
    """Write beside the target, flush to disk, then replace it."""
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def safe_path(root: Path, path: str) -> Path:
    """A path below the root; absolute ones, '..' and ways out of the root are rejected."""
    p = Path(path)
    full = (root / p).resolve()
    if p.is_absolute() or ".." in p.parts or not full.is_relative_to(root.resolve()):
        raise ValueError(f"unsafe path: {path}")
    return full


def _git_status(root: Path) -> str:
    """Short status of the worktree, empty where it is clean or no repository."""
    if not (root / ".git").exists():
        return ""
    return subprocess.check_output(["git", "-C", str(root), "status", "--porcelain"], text=True).strip()


def mapping_of(spark: SparkSession, plan: list[dict], vault: vaults.Vault | None = None) -> DataFrame:
    """(old, new) of a plan's moves, with and without suffix.

    With a vault the bare name of a source is one too, where no other note has that name, so that
    links by name follow a note in a folder.
    """
    rows = {}
    for item in plan:
        s, t = item["source"], item["target"].removesuffix(".md")
        rows |= {s: t, s.removesuffix(".md"): t}
    known = spark.createDataFrame(list(rows.items()), "old string, new string")
    if vault is None:
        return known
    moves = spark.createDataFrame([(i["source"], i["target"].removesuffix(".md")) for i in plan], "path string, new string")
    alone = vault.stems.where("n = 1").select(F.col("winner").alias("path"), F.col("stem").alias("old"))
    named = moves.join(alone, "path").select("old", "new")
    return known.unionByName(named.join(known.select("old"), "old", "left_anti"))


def _checked(root: Path, plan: list[dict]) -> None:
    for item in plan:
        source, target = safe_path(root, item["source"]), safe_path(root, item["target"])
        if source == target:
            raise ValueError(f"source and target are the same: {item['source']}")
        for role, path in (("source", source), ("target", target)):
            if not path.is_file():
                raise ValueError(f"{role} missing: {path.relative_to(root.resolve())}")
            planned = item.get(f"{role}_sha256")
            if planned and planned != digest(path):
                raise ValueError(f"{role} changed since the plan was made: {item[role]}")


def planned_changes(vault: vaults.Vault, plan: DataFrame, mapping: DataFrame, source_after: str) -> DataFrame:
    """(path, old_text, new_text) of everything a plan changes: inbound links, then stubs for the sources."""
    moved = rewrite.migrate_links(vault.notes, mapping)
    if source_after != "redirect":
        return moved
    stubs = rewrite.redirect_stubs(plan, vault.notes)
    return moved.join(stubs.select("path"), "path", "left_anti").unionByName(stubs)


def apply_plan(
    spark: SparkSession,
    root: str | Path,
    plan: list[dict],
    write: bool = False,
    confirm: bool = False,
    source_after: str = "redirect",
    require_clean_git: bool = False,
) -> dict:
    """Preview or carry out a plan; the report holds diffs, statistics and, after a write, the manifest's path.

    Writing needs ``confirm``. The plan is a reviewed list, so it is held on the driver, as are
    the files it changes while they are written.
    """
    root = Path(root)
    if source_after not in AFTER:
        raise ValueError(f"source_after must be one of {AFTER}")
    if write and not confirm:
        raise ValueError("writing needs confirm=True")
    if write and require_clean_git and _git_status(root):
        raise ValueError("the git worktree has uncommitted changes")
    if not plan:
        return {"write": write, "changes": [], "stats": {}, "manifest": None, "source_deleted": False}
    status = _git_status(root)
    vault = _vault(spark, root).cache()
    mapping = cut(mapping_of(spark, plan, vault))
    issues = [r.asDict() for r in redirects.preflight(vault, mapping).collect()]
    if issues:
        raise PreflightError(issues)
    _checked(root, plan)
    rows = spark.createDataFrame([(i["source"], i["target"]) for i in plan], "source string, target string")
    stats = redirects.migration_stats(vault, mapping).first().asDict()
    changes = {r["path"]: (r["old_text"], r["new_text"]) for r in planned_changes(vault, rows, mapping, source_after).collect()}
    named = [(i["source"], i["target"]) for i in plan if i.get("preserve_alias")]
    if named:
        kept = spark.createDataFrame(named, "source string, target string")
        taken = rewrite.alias_collisions(kept, vault.notes).orderBy("source", "path").first()
        if taken:
            raise ValueError(f"alias {taken['alias']!r} is already used by {taken['path']}")
    for source, path in named:
        old = changes[path][0] if path in changes else (root / path).read_text("utf-8")
        new = rewrite.alias_text(changes[path][1] if path in changes else old, Path(source).stem)
        if new != old:
            changes[path] = (old, new)
    report = {"write": write, "stats": stats, "source_deleted": False, "manifest": None}
    frame = spark.createDataFrame([(p, a, b) for p, (a, b) in changes.items()], "path string, old_text string, new_text string")
    report["changes"] = [r.asDict() for r in rewrite.diff(frame).orderBy("path").collect()]
    report["items"] = [{**i, "status": "applied" if write else "dry-run", "source_after": source_after, "source_deleted": False} for i in plan]
    if write:
        lost = _lost_fragments(vault)

        def check() -> None:
            more = _lost_fragments(_vault(spark, root)) - lost
            if more:
                raise OSError(f"fragments lost: {', '.join(f'{file} #{fragment}' for file, fragment in sorted(more))}")

        facts = {"git_status_before": status, "preflight": {"status": "passed", "issues": []}, "reports": report["items"]}
        gone = [i["source"] for i in plan] if source_after == "trash" else []
        report["manifest"] = str(commit(root, {p: new for p, (_, new) in changes.items()}, gone, stats, facts, check))
    return report


def _vault(spark: SparkSession, root: Path) -> vaults.Vault:
    return vaults.from_git(spark, root) if (root / ".git").exists() else vaults.from_disk(spark, root)


def _lost_fragments(vault: vaults.Vault) -> set[tuple[str, str]]:
    """(file, fragment) of links whose fragment is not there: a vault's faults, listed on the driver."""
    rows = redirects.verify_fragments(vault).where("not ok and fragment is not null").select("file", "fragment").distinct().collect()
    return {(r["file"], r["fragment"]) for r in rows}


def commit(
    root: Path, texts: dict[str, str], trash: list[str], stats: dict, facts: dict | None = None, check: Callable[[], None] | None = None
) -> Path:
    """Write all texts and move trashed files, or nothing; returns the manifest.

    ``facts`` are further fields of the manifest; ``check`` looks at the written vault and undoes
    the commit by raising.
    """
    stamp = datetime.now(UTC)
    folder = root / BACKUPS / stamp.strftime("%Y%m%dT%H%M%S%f")
    touched = sorted({*texts, *trash})
    files = []
    for path in touched:  # all backups come before the first write
        data = safe_path(root, path).read_bytes()
        write_atomic(folder / path, data)
        after = None if path in trash else hashlib.sha256(texts[path].encode()).hexdigest()
        files.append({"path": path, "before_sha256": hashlib.sha256(data).hexdigest(), "after_sha256": after, "backup": str((folder / path).relative_to(root))})
    try:
        for path, text in texts.items():
            if path not in trash:
                write_atomic(root / path, text.encode())
        for path in trash:
            (root / TRASH / path).parent.mkdir(parents=True, exist_ok=True)
            os.replace(root / path, root / TRASH / path)
        wrong = [f["path"] for f in files if digest(root / f["path"]) != f["after_sha256"]]
        if wrong:
            raise OSError(f"verification failed: {', '.join(wrong)}")
        if check:
            check()
        manifest = folder / "manifest.json"
        head = {"schema": SCHEMA, "tool_version": VERSION, "created_at": stamp.isoformat(), "migration_stats": stats}
        data = {**head, **(facts or {}), "files": files}
        write_atomic(manifest, json.dumps(data, ensure_ascii=False, indent=2).encode())
    except BaseException:
        for f in reversed(files):
            write_atomic(root / f["path"], (root / f["backup"]).read_bytes())
            (root / TRASH / f["path"]).unlink(missing_ok=True)
        raise
    return manifest


def read_manifest(path: str | Path) -> dict:
    data = json.loads(Path(path).read_text("utf-8"))
    if not isinstance(data, dict) or not str(data.get("schema")).endswith(READABLE):
        raise ValueError("not a manifest of a known schema")
    return data


def verify_manifest(root: str | Path, manifest: str | Path) -> list[dict]:
    """Whether files and backups are as the manifest says."""
    root, out = Path(root), []
    for f in read_manifest(manifest)["files"]:
        now, backup = digest(safe_path(root, f["path"])), digest(safe_path(root, f["backup"]))
        out.append(
            {
                "path": f["path"],
                "ok": now == f["after_sha256"] and backup == f["before_sha256"],
                "current_sha256": now,
                "expected_after_sha256": f["after_sha256"],
                "backup_sha256": backup,
                "expected_before_sha256": f["before_sha256"],
            }
        )
    return out


def rollback(root: str | Path, manifest: str | Path, write: bool = False, confirm: bool = False) -> list[dict]:
    """Put backups back where files are still as they were left; others are reported and stay."""
    if write and not confirm:
        raise ValueError("writing needs confirm=True")
    root, out = Path(root), []
    for f in read_manifest(manifest)["files"]:
        path, backup = safe_path(root, f["path"]), safe_path(root, f["backup"])
        error = None
        if f["after_sha256"] is not None and digest(path) != f["after_sha256"]:
            error = "file changed since the commit"
        elif digest(backup) != f["before_sha256"]:
            error = "backup missing or changed"
        elif write:
            write_atomic(path, backup.read_bytes())
        status = "conflict" if error else ("restored" if write else "preview")
        out.append({"path": f["path"], "backup": f["backup"], "ok": error is None, "status": status, "error": error})
    return out


def write_changes(root: str | Path, changes: DataFrame, confirm: bool = False) -> int:
    """Write a transform's changed notes, atomically one by one, on the executors' shared view of the root.

    Meant for vaults on a file system all workers see; each note is its own file, so tasks never
    meet. Returns the number of files.
    """
    if not confirm:
        raise ValueError("writing needs confirm=True")
    base = str(root)

    def put(batches):
        import pandas as pd

        for pdf in batches:
            for p, t in zip(pdf["path"], pdf["new_text"], strict=True):
                write_atomic(safe_path(Path(base), p), t.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    return changes.select("path", "new_text").mapInPandas(put, "n bigint").agg(F.sum("n")).first()[0] or 0
