"""Table functions for SQL: one text in, its obligations or tools out, one row each.

For whole tables use the operators of ``operators.audit``, which work in Arrow
batches; these are for looking at single texts in a statement.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from litmusq.operators.audit import obligations_in, tools_in


class _Obligations:
    def eval(self, path: str, text: str) -> Iterator[tuple]:
        yield from obligations_in(path, text)


class _Tools:
    def eval(self, path: str, text: str) -> Iterator[tuple]:
        for t in tools_in(path, text):
            yield t["name"], t["description"], t["return_type"]


def register(spark: SparkSession) -> None:
    """Names ``extract_obligations(path, text)`` and ``extract_tools(path, text)`` in the session; null texts give no row."""
    spark.udtf.register("extract_obligations", udtf(_Obligations, returnType="obligation_id string, obligation_type string, source_text string, path string, at bigint"))
    spark.udtf.register("extract_tools", udtf(_Tools, returnType="name string, description string, return_type string"))
