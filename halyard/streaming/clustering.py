"""An extension: fitted centers that follow a stream, and labels for its rows.

Each micro-batch is one moving-average update, as in scheduled clustering with a
constant step. The state (k centers and masses) lives on the driver and is written
after every micro-batch, so a restarted query goes on from the last one done.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from halyard.functions.vectors import vector
from halyard.operators.emeans import ema
from halyard.plans.lloyd import dense_assign, total


class StreamingCenters:
    """Centers that take in micro-batches."""

    def __init__(self, centers: np.ndarray, alpha: float = 0.1, mass: np.ndarray | None = None, features: str = "features") -> None:
        self.centers, self.alpha, self.features = np.array(centers, float), alpha, features
        self.mass = np.zeros(len(self.centers)) if mass is None else np.array(mass, float)
        self.last_batch = -1

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """One update; a micro-batch that comes again is not taken in twice."""
        if batch_id <= self.last_batch:
            return
        k, d = self.centers.shape
        found = total(batch.select(vector(batch, self.features).alias("features")), dense_assign(self.centers), k, d)
        self.centers, self.mass = ema(self.centers, self.mass, found.sums, found.counts, self.alpha)
        self.last_batch = batch_id

    def state(self, spark) -> DataFrame:
        """cid, center, mass."""
        return spark.createDataFrame([(i, c.tolist(), float(m)) for i, (c, m) in enumerate(zip(self.centers, self.mass, strict=True))], "cid int, center array<double>, mass double")

    def follow(self, stream: DataFrame, checkpoint: str, sink: str | None = None) -> StreamingQuery:
        """Starts a query that updates the centers, and writes their state to ``sink`` if given."""

        def run(batch: DataFrame, batch_id: int) -> None:
            self.update(batch, batch_id)
            if sink:
                self.state(batch.sparkSession).write.mode("overwrite").parquet(sink)

        return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
