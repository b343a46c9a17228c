"""inkmesh: analytics over vaults of interlinked notes and text corpora, on PySpark."""

from inkmesh.session import get_spark

__all__ = ["get_spark"]
