"""Features and results as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from featlab.operators.redundancy import AlphaInvesting
from featlab.plans import results


def alpha_investing_stream(errors: DataFrame, w0: float = 10.0, dw: float = 0.01) -> DataFrame:
    """errors: a stream of (run, n, j, error): features offered to a run in order of j within a batch, with the error each leaves beside those chosen before.
    (run, j, accepted, wealth): wealth and error are kept as state across batches."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wealth, seen, error = state.get if state.exists else (w0, 0, 1.0)
        out = []
        for row in sorted((r for p in parts for r in p.itertuples(index=False)), key=lambda r: r.j):
            a = AlphaInvesting(row.n, wealth, dw)
            a.seen, a.error = seen, error
            ok = a.offer(row.j, row.error)
            wealth, seen, error = a.w, a.seen, a.error
            out.append((row.run, row.j, ok, wealth))
        state.update((wealth, seen, error))
        yield pd.DataFrame(out, columns=["run", "j", "accepted", "wealth"])

    return errors.groupBy("run").applyInPandasWithState(run, "run string, j int, accepted boolean, wealth double", "wealth double, seen int, error double", "append", GroupStateTimeout.NoTimeout)


def upsert_stream(new: DataFrame, path: str, checkpoint: str, table: str = "results"):
    """Write a stream of result rows into the table at path, each batch by the table's upsert rule."""

    def write(batch: DataFrame, _: int) -> None:
        results.save(results.upsert_table(table, results.open_or_create(batch.sparkSession, path), batch), path)

    return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
