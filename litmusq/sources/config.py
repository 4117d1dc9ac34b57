"""Settings, providers of generated material, and stores, behind small interfaces."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that hold where a file says nothing else.
DEFAULTS: dict[str, object] = {"goal": "persuasive", "seed": 7, "n_rounds": 2, "n_init_scorers": 8, "n_repair_scorers": 6, "n_init_pairs": 24, "n_repair_pairs": 12, "test_fraction": 0.33, "n_candidates": 4, "min_init_heldout": 8, "min_r1_heldout": 15}


def settings(path: str | None = None, defaults: dict[str, object] | None = None) -> dict[str, object]:
    """The defaults with the top-level settings of a file over them; a missing or empty file changes nothing.

    JSON needs nothing else; YAML is read where its parser is installed.
    """
    out = dict(DEFAULTS if defaults is None else defaults)
    if path is None or not Path(path).exists():
        return out
    text = Path(path).read_text()
    try:
        given = json.loads(text or "null")
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} is no JSON and there is no YAML parser") from e
        given = yaml.safe_load(text)
    if given is not None and not isinstance(given, dict):
        raise ValueError(f"{path} holds no settings")
    return out | (given or {})


class Provider(ABC):
    """Where generated material comes from: seven kinds, each a table in order (ord), at most ``count`` rows."""

    KINDS = ("research", "taste_map", "scorers", "pairs", "repair_scorers", "adversarial_pairs", "candidates")

    @abstractmethod
    def generate(self, kind: str, count: int | None = None) -> DataFrame: ...


class TableProvider(Provider):
    """Material recorded in tables, by kind; nothing is generated."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.tables = tables

    def generate(self, kind: str, count: int | None = None) -> DataFrame:
        if kind not in self.KINDS or kind not in self.tables:
            raise KeyError(kind)
        df = self.tables[kind]
        return df if count is None else df.orderBy("ord").limit(count)


class Store(ABC):
    """Named tables."""

    @abstractmethod
    def read(self, name: str) -> DataFrame | None: ...

    @abstractmethod
    def write(self, name: str, df: DataFrame) -> None: ...


class FolderStore(Store):
    """Parquet tables below a folder of any file system Spark knows; a missing table is None."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(conf).exists(target)

    def read(self, name: str) -> DataFrame | None:
        path = f"{self.folder}/{name}"
        return self.spark.read.parquet(path) if self._exists(path) else None

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")


def output_folder(spark: SparkSession, *choices: str | None) -> str:
    """The first folder given that exists or can be made."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for choice in choices:
        if choice:
            target = jvm.org.apache.hadoop.fs.Path(choice)
            try:
                if target.getFileSystem(conf).mkdirs(target):
                    return choice
            except Exception:  # not writable: the next one
                continue
    raise ValueError("no folder to write to")


def failure_points(aggregates: DataFrame, limit: int = 200) -> str:
    """Markdown of (stage, signal, missed) counts, most missed first; at most ``limit`` lines, the total is of all."""
    total = aggregates.agg(F.coalesce(F.sum("missed"), F.lit(0))).first()[0]
    rows = aggregates.orderBy(F.desc("missed"), "stage", "signal").limit(limit).collect()
    return "\n".join(["# Failure points", "", f"{total} in all", "", *[f"- stage {r.stage}, {r.signal}: {r.missed}" for r in rows]]) + "\n"
