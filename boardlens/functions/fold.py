"""A stateful walk along every series of a table.

For computations whose next step depends on the last one's outcome, which no window
function expresses. Series are spread over tasks and sorted there by Spark (which
spills), rows come as Arrow batches, and only one series' state is held at a time:
it is carried over batch borders and dropped when the next series begins. A fold may
give only some of the rows back, so a long trace need not be written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _cuts(batch: pa.RecordBatch, keys: Sequence[str]) -> list[int]:
    change = np.zeros(max(len(batch) - 1, 0), bool)
    for key in keys:
        column = batch.column(key)
        change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    new_state: Callable[[], Any],
    step: Callable[[Any, pa.RecordBatch], dict[str, pa.Array]],
    added: str,
    keep: Callable[[pa.RecordBatch], np.ndarray] | None = None,
) -> DataFrame:
    """``df`` with the columns ``added`` that ``step(state, rows)`` gives for consecutive rows of one series.

    ``keys`` must not be NULL. A series is read by one task, whatever its length;
    memory is one batch and one state. With ``keep``, a function of rows with their
    added columns, only rows it marks and the last row of every series are given.
    """
    names = [part.strip().split(" ")[0] for part in _top_level(added)]
    extra = df.sparkSession.createDataFrame([], added).schema
    schema = T.StructType([*df.schema.fields, *extra.fields])
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, state, tail = None, None, None
        for batch in batches:
            if not len(batch):
                continue
            parts: list[pa.RecordBatch] = []
            cuts = _cuts(batch, keys)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows = batch.slice(a, b - a)
                here = tuple(rows.column(k)[0].as_py() for k in keys)
                if here != series:
                    if tail is not None:
                        parts.append(tail)
                    series, state, tail = here, new_state(), None
                found = step(state, rows)
                out = pa.RecordBatch.from_arrays([*rows.columns, *[found[n] for n in names]], [*rows.schema.names, *names])
                if keep is not None:
                    marked = keep(out)
                    tail = None if marked[-1] else out.take(pa.array([len(out) - 1]))
                    out = out.filter(pa.array(marked))
                parts.append(out)
            yield from (p for p in parts if len(p))
        if tail is not None:
            yield tail

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _top_level(ddl: str) -> list[str]:
    """Column definitions of a DDL string, split at commas outside brackets."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
