"""Rules that change while packets come: validity intervals, and which rules were in force at a packet's time.

Edits are rows (at, seq, action, kind, value): `block` or `unblock` of a value, or `clear` of everything; seq orders edits of one time. Blocking
what is blocked changes nothing, but patterns are kept as often as they are blocked and each unblock takes one of them away.

`as_of` finds the last row of the right side before each row of the left. It works in buckets of time, with what was last before each bucket carried
in, so a key may hold any part of all rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .patterns import pattern_matches

#: Microseconds of a bucket: a day.
WIDTH = 86_400_000_000
KINDS = ["IP", "PORT", "APP", "DOMAIN", "PATTERN"]
EDITS = "at timestamp, seq long, action string, kind string, value string"


def _stored(df: DataFrame) -> DataFrame:
    """The rows in a folder of the checkpoint folder, where the session names one: what several branches of a plan read is computed once."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/rule-times-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_of(left: DataFrame, right: DataFrame, on: list[str], time: str, order: str, take: str, width: int = WIDTH) -> DataFrame:
    """The left rows with `take` of the right row with the same `on` that is last at or before them (null: none).

    A key with a null in it meets nothing. Both sides have `on`, `time` (long) and `order` (long, decides within a time: a right row counts for left rows whose order isn't less).
    """
    bucket = F.floor(F.col(time) / width).cast("long")
    kind = right.schema[take].dataType
    rest = [c for c in left.columns if c not in (*on, time, order)] or [time]
    l = left.select(*on, F.col(time).alias("_t"), F.col(order).alias("_o"), bucket.alias("_b"), F.lit(1).alias("_side"), F.struct(*rest).alias("_row"), F.lit(None).cast(kind).alias("_take"))
    r = right.dropna(subset=on).select(*on, F.col(time).alias("_t"), F.col(order).alias("_o"), bucket.alias("_b"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(take).alias("_take"))
    ends = r.groupBy(*on, "_b").agg(F.max_by(F.struct("_take"), F.struct("_t", "_o")).alias("_end"))
    seen = l.groupBy(*on, "_b").agg(F.lit(None).cast(ends.schema["_end"].dataType).alias("_end"))
    every = ends.union(seen).groupBy(*on, "_b").agg(F.first("_end", ignorenulls=True).alias("_end"))
    before = Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(*on, "_b", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*on, "_b").orderBy("_t", "_o", "_side").rowsBetween(Window.unboundedPreceding, 0)
    marked = l.union(r).withColumn("_last", F.last(F.when(F.col("_side") == 0, F.struct("_take")), ignorenulls=True).over(inside)).where("_side = 1")
    joined = marked.alias("m").join(carried.alias("c"), [*on, "_b"], "left")  # both are dealt out by these columns already
    own = {c: F.col(c) for c in on} | {time: F.col("m._t"), order: F.col("m._o")}
    return joined.select(*[own.get(c, F.col(f"m._row.{c}")).alias(c) for c in left.columns], F.coalesce(F.col("m._last"), F.col("c._carried"))["_take"].alias(take))


def versions(edits: DataFrame) -> DataFrame:
    """(kind, value, time, order, blocked): the state of each rule after each edit that concerns it, clears included; values in the form in which packets ask for them."""
    e = edits.select(F.unix_micros("at").alias("time"), F.col("seq").cast("long").alias("order"), "action", "kind", F.when(F.col("kind") == "DOMAIN", F.lower("value")).otherwise(F.col("value")).alias("value"))
    clears = e.where("action = 'clear'").select(F.lit(0).alias("all"), "time", "order").withColumn("clear", F.struct("time", "order"))
    own = e.where("action in ('block', 'unblock')").withColumn("all", F.lit(0))
    own = as_of(own, clears, ["all"], "time", "order", "clear").withColumnRenamed("clear", "since")
    along = Window.partitionBy("kind", "value", "since").orderBy("time", "order")
    step = F.when(F.col("action") == "block", 1).otherwise(-1)
    total = F.sum(step).over(along.rowsBetween(Window.unboundedPreceding, 0))
    held = own.withColumn("_sum", total)
    held = held.withColumn("_n", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(along.rowsBetween(Window.unboundedPreceding, 0))))
    blocked = F.when(F.col("kind") == "PATTERN", F.col("_n") > 0).otherwise(F.col("action") == "block")
    after = held.select("kind", "value", "time", "order", blocked.alias("blocked"))
    # A clear ends every rule that was edited since the clear before it: the first clear after an edit is the last one before it when time runs backwards.
    back = own.select("kind", "value", (-F.col("time")).alias("time"), (-F.col("order")).alias("order"), F.lit(0).alias("all"))
    turned = clears.select("all", (-F.col("time")).alias("time"), (-F.col("order")).alias("order"), "clear")
    ended = as_of(back, turned, ["all"], "time", "order", "clear").where("clear is not null").select("kind", "value", "clear").distinct()
    return after.union(ended.select("kind", "value", "clear.time", "clear.order", F.lit(False)))


def intervals(edits: DataFrame) -> DataFrame:
    """(kind, value, from, to): when each rule was in force; `to` is null if it still is."""
    v = versions(edits)
    along = Window.partitionBy("kind", "value").orderBy("time", "order")
    changes = v.withColumn("_before", F.coalesce(F.lag("blocked").over(along), F.lit(False))).where("blocked <> _before")
    spans = changes.withColumn("_next", F.lead("time").over(along)).where("blocked")
    return spans.select("kind", "value", F.timestamp_micros("time").alias("from"), F.timestamp_micros("_next").alias("to"))


def lookups(rows: DataFrame, edits: DataFrame, ip: str, port: str, app: str, name: str) -> DataFrame:
    """(_id, time, kind, value) of all that a row asks the rules for: its address, port, application, name and the patterns that match its name."""
    asked = rows.select("_id", "time", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("IP", F.col(ip)), ("PORT", F.col(port).cast("string")), ("APP", F.col(app)), ("DOMAIN", F.lower(name)))])).alias("ask")).select("_id", "time", "ask.*").where("value <> ''")
    named = rows.where(F.col(name) != "").select("_id", "time", F.lower(name).alias("name"))
    patterns = edits.where("kind = 'PATTERN'").select("value").distinct()
    hits = pattern_matches(named, patterns).join(patterns.withColumn("pattern", F.lower("value")), "pattern").select("name", "value")
    return asked.union(named.join(hits, "name").select("_id", "time", F.lit("PATTERN"), "value"))


def block_reason_as_of(rows: DataFrame, edits: DataFrame, time: Column, ip: str = "src_ip_s", port: str = "dst_port", app: str = "app", name: str = "name") -> DataFrame:
    """The rows with `reason`: the first kind of rule (IP, PORT, APP, DOMAIN) that was in force at the row's time; null if none was, or without a time.

    An edit counts from its own time on. Rows keep all their columns; repeated rows are judged each by itself.
    """
    key = _stored(rows.withColumns({"_id": F.unhex(F.md5(F.to_json(F.struct(ip, port, app, name, time.alias("_time"))))), "time": F.unix_micros(time)}))
    edits = _stored(edits)
    distinct = key.where("time is not null").select("_id", "time", ip, port, app, name).distinct()
    asked = lookups(distinct, edits, ip, port, app, name).withColumn("order", F.lit(2**63 - 1))
    known = _stored(versions(edits))
    held = _stored(asked.join(known.select("kind", "value").distinct(), ["kind", "value"], "left_semi"))  # what no rule was ever about needs no look back
    found = as_of(held, known, ["kind", "value"], "time", "order", "blocked").where("blocked")
    rank = F.element_at(F.create_map(*[x for k, v in (("IP", 0), ("PORT", 1), ("APP", 2), ("DOMAIN", 3), ("PATTERN", 3)) for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    first = found.groupBy("_id").agg(F.min(rank).alias("_rank"))
    reason = F.when(F.col("_rank") == 0, "IP").when(F.col("_rank") == 1, "PORT").when(F.col("_rank") == 2, "APP").when(F.col("_rank") == 3, "DOMAIN")
    return key.join(first, "_id", "left").withColumn("reason", reason).drop("_id", "time", "_rank")
