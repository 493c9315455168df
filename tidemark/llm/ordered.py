"""Rows next to each other in a global order, without bringing the order into one task.

Bounds split the order into cells. A row goes to its cell, and the first row of each cell goes to the cell before
as well, so that every task sees the follower of each of its rows. Only bounds and first keys, one for each cell,
come to the driver.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release

Key = tuple


def cell_bounds(keys: DataFrame, cells: int) -> tuple[list[Key], list[Key]]:
    """Greatest and smallest key of each non-empty cell, in order; ``keys`` holds non-null key columns only.

    Spark's own range partitioning picks where the cells end; the bounds are then exact, whatever it sampled.
    """
    names = keys.columns
    key = F.struct(*names) if len(names) > 1 else F.col(names[0])
    ends = (
        keys.repartitionByRange(cells, *names)
        .groupBy(F.spark_partition_id().alias("cell"))
        .agg(F.min(key).alias("low"), F.max(key).alias("high"))
        .collect()
    )
    whole = lambda x: tuple(x) if len(names) > 1 else (x,)
    bounds = sorted((whole(r.low), whole(r.high)) for r in ends)  # two keys for each cell
    return [high for _, high in bounds], [low for low, _ in bounds]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    release()


def with_cells(
    rows: DataFrame, names: list[str], highs: list[Key], lows: list[Key], wrap: bool = False, both: bool = False
) -> DataFrame:
    """``rows`` with columns cell and halo. A halo row is the first of the next cell, or with ``wrap`` of all.

    With ``both``, the last of the cell before is a halo row as well. Rows that share such a key all get a halo copy;
    the order among them is the reader's.
    """
    places = [rows.columns.index(n) for n in names]
    before = {low: i - 1 for i, low in enumerate(lows) if i}
    after = {high: i + 1 for i, high in enumerate(highs[:-1])} if both else {}
    last = len(lows) - 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            take, cells, halo = [], [], []
            for i, key in enumerate(zip(*(batch.column(p).to_pylist() for p in places), strict=True)):
                take.append(i)
                cells.append(min(bisect.bisect_left(highs, key), last))
                halo.append(0)
                if key in before:
                    take.append(i)
                    cells.append(before[key])
                    halo.append(1)
                if key in after:
                    take.append(i)
                    cells.append(after[key])
                    halo.append(1)
                if wrap and key == lows[0]:
                    take.append(i)
                    cells.append(last)
                    halo.append(2)
            picked = batch if len(take) == batch.num_rows else batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, pa.array(cells, pa.int32()), pa.array(halo, pa.int32())],
                [*batch.schema.names, "cell", "halo"],
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, ("cell", "int"), ("halo", "int")])
    return rows.mapInArrow(spread, schema)


def in_order(rows: DataFrame, names: list[str], partitions: int) -> DataFrame:
    """Rows of ``with_cells`` dealt out by cell, each cell in order, its halo rows last."""
    return rows.repartition(partitions, "cell").sortWithinPartitions("cell", "halo", *names)


def walk(
    batches: Iterator[pa.RecordBatch], visit: Callable[[dict, dict | None], dict], fields: list[str], out: pa.Schema, rows: int
) -> Iterator[pa.RecordBatch]:
    """Call ``visit(row, follower)`` for each row of ordered cells; halo rows only follow.

    One row is held at a time. The follower of a cell's last row is None where the cell has no halo row.
    """
    held: dict | None = None
    made: list[dict] = []
    for batch in slices(batches):
        columns = [batch.column(batch.schema.get_field_index(f)).to_pylist() for f in fields]
        for values in zip(*columns, strict=True):
            row = dict(zip(fields, values, strict=True))
            if held is not None:
                made.append(visit(held, row if row["cell"] == held["cell"] else None))
                held = None
                if len(made) >= rows:
                    yield pa.RecordBatch.from_pylist(made, out)
                    made = []
            held = None if row["halo"] else row
    if held is not None:
        made.append(visit(held, None))
    yield pa.RecordBatch.from_pylist(made, out)
