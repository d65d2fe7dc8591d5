"""Flow counters of a stream: event-time sessions that end after an idle time.

The state is Spark's session-window aggregate, so it spills, expires by watermark and survives lost executors.
The same function works on a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDLE = "300 seconds"


def flow_sessions(packets: DataFrame, key: list[str], time: str = "event_ts", idle: str = IDLE, late: str | None = None) -> DataFrame:
    """One row per key and run of packets without an idle gap: start, end (with the idle time), packets, bytes.

    late: how much packets of a stream may be out of order; None for a batch.
    """
    rows = packets.withWatermark(time, late) if late else packets
    by = rows.groupBy(*key, F.session_window(time, idle).alias("_w")).agg(F.count("*").alias("packets"), F.sum("frame_len").alias("bytes"))
    return by.select(*key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "packets", "bytes")
