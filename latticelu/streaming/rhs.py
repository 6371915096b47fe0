"""Right-hand sides that arrive as a stream, solved with stored factors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.solver import Factors


def solve_stream(factors: Factors, rhs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Start a query over a stream of (rhs_id, i, v): each micro-batch's solutions go to `sink`.

    A right-hand side must arrive whole within a micro-batch, as one file does.
    """
    writer = rhs.writeStream.foreachBatch(lambda batch, epoch: sink(factors.solve(batch), epoch))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
