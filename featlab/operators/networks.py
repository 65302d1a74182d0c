"""The concrete autoencoder trained over all rows of a distributed matrix.

Rows are dealt to shares, at most one a core. In a round each share's task goes on from the same state through
its own rows, batch by batch, for some epochs; then the states (weights and the optimiser's moments) are averaged by
rows. A row is used in as many epochs as in one task; only states, whose size depends on features and K, travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlab.operators import solvers
from featlab.operators.selectors import Concrete, ranked

#: Rows that a share has at least, and epochs between two averages.
LEAST, EPOCHS = 1024, 10


def _scaling(wide: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    with solvers.training(wide) as rows:
        p, n = rows.p, rows.n
        total = solvers.added(rows.blocks, lambda x, y: np.concatenate((x.sum(0), (x * x).sum(0))), 2 * p)
    mean = total[:p] / n
    var = total[p:] / n - mean**2
    return mean, np.where(var > 1e-12 * np.maximum(mean**2, 1e-300), np.sqrt(np.maximum(var, 0)), 1.0), n


def concrete_autoencoder(wide: DataFrame, k: int, num_epochs: int = 800, batch_size: int = 16, learning_rate: float = 1e-3, start_temp: float = 10.0, min_temp: float = 0.1, seed: int = 0) -> DataFrame:
    """(rank, j, score): as selectors.concrete_autoencoder, on all rows; the same where there is one share."""
    wide = wide.where("label IS NOT NULL AND features IS NOT NULL")
    mean, scale, n = _scaling(wide)
    shares = max(1, min(wide.sparkSession.sparkContext.defaultParallelism, n // LEAST))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                x = 1 / (1 + np.exp(-(np.array(part["features"].tolist(), float) - mean) / scale))
                yield pd.DataFrame({"id": part["id"], "share": part["share"], "x": [v.tobytes() for v in x.astype(np.float32)]})

    dealt = wide.select("id", "features", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int").alias("share")).mapInPandas(packed, "id long, share int, x binary")
    rows = dealt.repartitionByRange(shares, "share").sortWithinPartitions("share", "id").persist()
    p = len(mean)
    model = Concrete(min(k, p), p, np.random.default_rng([seed, k]), learning_rate)
    options = (num_epochs, batch_size, start_temp, min_temp)
    try:
        for began in range(0, num_epochs, EPOCHS if shares > 1 else num_epochs):
            epochs = min(num_epochs - began, EPOCHS) if shares > 1 else num_epochs

            def run(batches: Iterator[pd.DataFrame], began=began, epochs=epochs, state=model.state(), rng=model.rng) -> Iterator[pd.DataFrame]:
                held: dict[int, list[bytes]] = {}
                for part in batches:
                    for share, here in part.groupby("share"):
                        held.setdefault(int(share), []).extend(here["x"])
                for share, some in held.items():
                    own = Concrete(min(k, p), p, rng if shares == 1 else np.random.default_rng([seed, k, share, began]), learning_rate, state)
                    own.train(np.frombuffer(b"".join(some), np.float32).reshape(len(some), p), began, epochs, *options)
                    yield pd.DataFrame({"n": [len(some)], "state": [own.state().tobytes()]})

            total, count = 0.0, 0
            for r in rows.mapInPandas(run, "n long, state binary").collect():  # a state a share
                total, count = total + r["n"] * np.frombuffer(r["state"], np.float32).astype(float), count + r["n"]
            model = Concrete(min(k, p), p, model.rng, learning_rate, (total / max(1, count)).astype(np.float32))
    finally:
        rows.unpersist()
    return solvers._frame(wide, *ranked(model.logits.mean(0), min(k, p)))
