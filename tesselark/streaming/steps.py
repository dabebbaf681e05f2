"""Time steps: the batch loop over steps, and the same step on a stream of particles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesselark.storage import cut

Step = Callable[[DataFrame, int], DataFrame]


def run_steps(particles: DataFrame, step: Step, n_steps: int, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Apply step n_steps times. Every state is checkpointed, so lineage does not grow with the steps; the loop ends when no particle is left."""
    for i in range(n_steps):
        particles = cut(step(particles, i))
        if each:
            each(particles, i)
        if particles.isEmpty():
            break
    return particles


def stream_steps(stream: DataFrame, step: Step, path: str, checkpoint: str) -> StreamingQuery:
    """Locate or push every micro-batch of a particle stream and append the result to Parquet under its batch number. A
    batch that is repeated after a failure overwrites its own folder, so each particle is written once."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deposits(stream: DataFrame, event_time: str, delay: str, window: str) -> DataFrame:
    """Particles of each element in event-time windows; rows later than delay are dropped. For writeStream in append mode."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, window), "elem_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "elem_id", "n")


def particle_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
