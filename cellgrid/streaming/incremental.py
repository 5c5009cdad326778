"""A cube that a stream keeps up: each micro-batch is a small cube, merged into the stored one.

Bitmaps are or-ed, so a batch that is delivered again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cube
from ..plans.specs import CubeSpec


def maintain(stream: DataFrame, spec: CubeSpec, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the stream that merges its rows into the cube at path; once: works off what is there, then ends."""

    def merge(batch: DataFrame, _: int) -> None:
        if (new := cube.build(batch, spec)) is not None and not new.isEmpty():
            cube.upsert(new, spec, path)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows by window and keys; a window closes when the watermark, late behind the newest row, has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("cnt"))
