"""Normalisation and keys of records as they arrive.

Both look at one record at a time, so they run unchanged on a stream. Frequencies, best candidates and
assignments need the whole table and have no streaming form here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.records import prepared


def normalised_stream(records: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends normalised records to Parquet, and ends once what is there has been read."""
    out = prepared(records.withColumn("country_key", F.lower("country")))
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
