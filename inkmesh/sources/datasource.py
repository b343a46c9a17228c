"""spark.read.format("vault"): the notes of a folder as a data source of its own.

Options: path (the root), files ('tracked' by git or 'disk'), prefix (narrows the notes before
any is read). A prefix that the query filters on (startswith) is pushed into the listing. Files
are dealt to partitions in batches; names that begin with '.' or '_' are read too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, StringStartsWith

BATCH = 256


@dataclass
class Files(InputPartition):
    paths: list[str]


class VaultReader(DataSourceReader):
    def __init__(self, root: str, files: str, prefix: str) -> None:
        self.root, self.files, self.prefixes = root, files, [prefix] if prefix else []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 Spark's name
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            else:
                yield f

    def partitions(self) -> list[Files]:
        from inkmesh.sources.vault import notes_on_disk, tracked_files

        every = notes_on_disk(self.root) if self.files == "disk" else [p for p in tracked_files(self.root) if p.endswith(".md")]
        kept = [p for p in every if all(p.startswith(x) for x in self.prefixes)]
        return [Files(kept[i : i + BATCH]) for i in range(0, len(kept), BATCH)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for p in partition.paths:
            try:
                data = (Path(self.root) / p).read_bytes()
            except OSError:
                continue  # listed but gone
            yield p, data.decode("utf-8", "ignore"), data


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "path string, text string, content binary"

    def reader(self, schema) -> VaultReader:
        o = self.options
        return VaultReader(o["path"], o.get("files", "tracked"), o.get("prefix", ""))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VaultSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
