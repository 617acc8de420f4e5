"""Tiles as a stream: windows of time over events, and tiles appended to a table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery



def event_cells(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour", cols: int = 16) -> DataFrame:
    """A cell for each time window and user column: count and mean of events, late ones beyond ``delay`` left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", width), (F.col("user_id") % cols).alias("col_idx")).agg(F.count("*").alias("n"), F.avg("value").alias("value"))


def ingest_tiles(tiles: DataFrame, table_path: str, checkpoint: str, nodata: float | None = None) -> StreamingQuery:
    """Append a stream of tiles to a Parquet tile table, partitioned by band; exactly once by the sink's own log."""
    if nodata is not None:
        tiles = tiles.withColumn("cells", F.transform("cells", lambda c: F.nullif(c, F.lit(nodata))))
    return tiles.writeStream.format("parquet").partitionBy("band").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["event_cells", "ingest_tiles"]
