"""Sinks: tables, artifacts, reports and zips."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmusq.operators.audit import severity_rank


def parquet(df: DataFrame, path: str, *partitions: str) -> None:
    """A table, one folder per value of the partition columns."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header; values are quoted where they need it."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Key-value table after changes: the greatest version of every key."""
    both = table.unionByName(changes)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")


def report(findings: DataFrame, limit: int = 200) -> str:
    """Findings as Markdown, worst first; (finding_type, severity, subject).  At most ``limit`` are shown, the counts are of all."""
    counts = {r.severity: r.n for r in findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
    shown = findings.withColumn("_r", severity_rank(F.col("severity"))).orderBy("_r", "finding_type", "subject").limit(limit).collect()
    head = ["# Findings", "", *[f"- {s}: {counts.get(s, 0)}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")], ""]
    return "\n".join(head + [f"- **{r.severity}** {r.finding_type}: {r.subject}" for r in shown]) + "\n"


def exit_code(findings: DataFrame, threshold: str) -> int:
    """1 if any finding is at least as severe as the threshold."""
    rank = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}[threshold]
    return 0 if findings.where(severity_rank(F.col("severity")) <= rank).isEmpty() else 1


def zipped(folder: str, target: str) -> None:
    """All JSON files below a folder in one zip file."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(Path(folder).rglob("*.json")):
            z.write(p, p.relative_to(folder))
