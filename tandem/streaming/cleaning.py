"""Streaming form of the row-wise operators.

The cleaning chain and the other column operators are plain expressions, so
the same functions run on a streaming DataFrame: new pair files landing in a
folder are cleaned incrementally and appended to a sink, with exactly-once
progress kept in the checkpoint location.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tandem.operators.clean import clean_pairs

PAIR_SCHEMA = "sid long, region string, standard string, dialect string"


def start_cleaning(spark: SparkSession, source: str, sink: str, checkpoint: str, fmt: str = "json",
                   schema: str = PAIR_SCHEMA, available_now: bool = True, sink_format: str = "parquet",
                   **clean_kw) -> StreamingQuery:
    """Clean pair files arriving in ``source`` and append them to ``sink``.

    ``sink_format="memory"`` makes ``sink`` a query name (for tests).
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    w = clean_pairs(stream, **clean_kw).writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    if sink_format == "memory":
        return w.format("memory").queryName(sink).start()
    return w.format(sink_format).option("path", sink).start()
