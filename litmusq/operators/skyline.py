"""Rows that no other row dominates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partitions merged into one in each round, and rows compared at once.
FAN_IN, BLOCK = 8, 1024


def _undominated(values: np.ndarray) -> np.ndarray:
    """Indexes of the undominated rows; equal rows don't dominate each other."""
    order = np.argsort(-values.sum(1), kind="stable")
    kept = np.zeros((0, values.shape[1]))
    out: list[np.ndarray] = []
    for i in range(0, len(order), BLOCK):
        part = order[i : i + BLOCK]
        v = values[part]
        alive = np.ones(len(part), bool)
        for against in (kept, v):
            for j in range(0, len(against), BLOCK):
                w = against[j : j + BLOCK]
                ge = (w[None] >= v[:, None]).all(2)
                gt = (w[None] > v[:, None]).any(2)
                alive &= ~(ge & gt).any(1)
        kept = np.concatenate((kept, v[alive]))
        out.append(part[alive])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _local(dims: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if table.num_rows:
                values = np.column_stack([table[d].cast(pa.float64()).to_numpy() for d in dims])
                held = table.take(np.sort(_undominated(values)))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def skyline(df: DataFrame, dims: list[str], maximise: bool = True) -> DataFrame:
    """The rows that no row beats in one dimension and equals or beats in all.

    Each partition keeps its own undominated rows; the survivors are merged in
    rounds of ``FAN_IN`` partitions, so a task never holds more than undominated
    rows of its part.  Rows with a null or NaN dimension are left out; equal
    rows stay together.
    """
    whole = F.lit(True)
    for d in dims:
        whole = whole & F.col(d).isNotNull() & ~F.isnan(F.col(d).cast("double"))
    flipped = {} if maximise else {d: -F.col(d) for d in dims}
    out = df.where(whole).withColumns(flipped)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        out = out.mapInArrow(_local(dims), out.schema)
        if parts <= 1:
            break
        parts = -(-parts // FAN_IN)
        out = out.repartition(parts)
    return out.withColumns({d: -F.col(d) for d in flipped})
