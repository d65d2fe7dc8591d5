"""Checks of rows that the other operators make: (problem, n) of each rule that rows break; empty where all is sound.

Every check is one aggregation with partial counts; nothing but the counts leaves the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The shapes of identifiers and of text that may be shown.
SIGNAL_ID = r"^[a-z0-9_]+#[0-9a-f]{12}$"
CHUNK_ID = r"^[^#]+#[a-z0-9-]*#\d{2,}-[0-9a-f]{12}$"
CONTROL = r"[\x00-\x1f\x7f]"
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH"]


def _broken(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rules (name -> what a sound row fulfils) that some rows break, and how many do; an unknown answer is a break."""
    counts = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"_{k}") for k, ok in enumerate(rules.values())])
    each = F.array(*[F.struct(F.lit(name).alias("problem"), F.col(f"_{k}").alias("n")) for k, name in enumerate(rules)])
    return counts.select(F.inline(each)).where("n > 0")


def _ascending(values: Column) -> Column:
    return values == F.array_sort(F.array_distinct(values))


def record_problems(records: DataFrame) -> DataFrame:
    """Flow records of a report (capture, flow_id, src_port, dst_port, bytes_out, bytes_in, server_name): ranges, numbering, clean names."""
    numbers = records.groupBy("capture").agg(F.count("*").alias("_n"), F.countDistinct("flow_id").alias("_d"), F.min("flow_id").alias("_lo"), F.max("flow_id").alias("_hi"))
    return _broken(records, {
        "source port": F.col("src_port").between(0, 65535), "destination port": F.col("dst_port").between(0, 65535), "negative bytes": (F.col("bytes_out") >= 0) & (F.col("bytes_in") >= 0),
        "control character": ~F.coalesce(F.col("server_name"), F.lit("")).rlike(CONTROL),
    }).union(_broken(numbers, {"numbering": (F.col("_lo") == 0) & (F.col("_d") == F.col("_n")) & (F.col("_hi") == F.col("_n") - 1)}))


def signal_problems(fired: DataFrame) -> DataFrame:
    """Signals (capture, signal, severity, confidence, evidence, flow_ids, position, signal_id): shapes, clean evidence, sorted lists, order, one of a kind."""
    in_capture = Window.partitionBy("capture")  # thirteen rows at most
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    rows = fired.withColumns({
        "_k": F.row_number().over(in_capture.orderBy(rank.desc(), F.desc("confidence"), "signal")), "_same": F.count("*").over(Window.partitionBy("capture", "signal")),
    })
    return _broken(rows, {
        "id": F.col("signal_id").rlike(SIGNAL_ID) & F.startswith(F.col("signal_id"), F.concat("signal", F.lit("#"))), "severity": rank > 0, "confidence": F.col("confidence").between(0.0, 1.0),
        "evidence": ~F.exists(F.map_values("evidence"), lambda v: F.coalesce(v, F.lit("")).rlike(CONTROL)) & (F.size("evidence") > 0), "flow ids": _ascending(F.col("flow_ids")),
        "order": F.col("position") == F.col("_k"), "repeated signal": F.col("_same") == 1,
    })


def chunk_problems(made: DataFrame, sections: DataFrame | None = None, max_chars: int | None = None) -> DataFrame:
    """Chunks: text, counts, hashes' shape, places 0 to chunk_count - 1 of each section; with `sections` (document_id, section), that theirs exists.

    Chunks are read once: what rules they break is counted by section, and the sections are judged and looked up.
    """
    by = ["document_id", "section"]
    rules = {
        "empty text": (F.trim("text") != "") | (F.col("chunk_count") == 1), "length": F.col("char_count") == F.length("text"), "overlap": F.col("overlap_chars").between(0, F.col("char_count")),
        "first overlaps": (F.col("chunk_index") > 0) | (F.col("overlap_chars") == 0), "id": F.col("chunk_id").rlike(CHUNK_ID), "digest": F.col("content_sha256").rlike("^[0-9a-f]{64}$"),
        "index": F.col("chunk_index").between(0, F.col("chunk_count") - 1),
    }
    if max_chars is not None:
        rules["too long"] = F.col("char_count") <= max_chars
    flags = made.select(*by, "chunk_index", "chunk_count", *[(~F.coalesce(ok, F.lit(False))).cast("long").alias(f"_{k}") for k, ok in enumerate(rules.values())])
    groups = flags.groupBy(*by).agg(
        F.count("*").alias("_n"), F.countDistinct("chunk_index").alias("_d"), F.max("chunk_count").alias("_c"), F.min("chunk_index").alias("_lo"), F.max("chunk_index").alias("_hi"),
        *[F.sum(f"_{k}").alias(f"_{k}") for k in range(len(rules))],
    )
    places = (F.col("_n") == F.col("_d")) & (F.col("_n") == F.col("_c")) & (F.col("_lo") == 0) & (F.col("_hi") == F.col("_c") - 1)
    counts = {name: F.sum(f"_{k}") for k, name in enumerate(rules)} | {"places": F.count_if(~F.coalesce(places, F.lit(False)))}
    if sections is not None:
        groups = groups.join(sections.select(*by).distinct().withColumn("_known", F.lit(True)), by, "left")
        counts["unknown section"] = F.sum(F.when(F.col("_known").isNull(), F.col("_n")).otherwise(0))
    found = groups.agg(*[n.alias(f"_{k}") for k, n in enumerate(counts.values())])
    each = F.array(*[F.struct(F.lit(name).alias("problem"), F.col(f"_{k}").alias("n")) for k, name in enumerate(counts)])
    return found.select(F.inline(each)).where("n > 0")


def ranking_problems(ranked: DataFrame, by: list[str], per_document: int | None = None) -> DataFrame:
    """Rankings (by, chunk_id, document_id, similarity, per_query, rank): finite and best of their queries, ranks without gaps in order, no repeats, caps kept."""
    group = Window.partitionBy(*by)  # as many rows as a ranking keeps
    rows = ranked.withColumns({
        "_k": F.row_number().over(group.orderBy(F.bround("similarity", 12).desc(), "chunk_id")) - 1, "_same": F.count("*").over(Window.partitionBy(*by, "chunk_id")), "_of": F.count("*").over(Window.partitionBy(*by, "document_id")),
    })
    return _broken(rows, {
        "similarity": F.col("similarity").between(-1.0, 1.0), "best of its queries": F.abs(F.array_max(F.map_values("per_query")) - F.col("similarity")) < 1e-12,
        "rank": F.col("rank") == F.col("_k"), "repeated chunk": F.col("_same") == 1, "cap": F.lit(True) if per_document is None else F.col("_of") <= per_document,
    })


def context_problems(walked: DataFrame, max_items: int | None = None, by: str = "capture") -> DataFrame:
    """Budget walks (by, chunk_id, position, reason): either taken or left out for a reason, places 0 to n - 1, no chunk twice."""
    rows = walked.withColumns({
        "_k": F.row_number().over(Window.partitionBy(by, F.col("position").isNull()).orderBy("position")) - 1, "_same": F.count("*").over(Window.partitionBy(by, "chunk_id")),
    })
    return _broken(rows, {
        "taken or left out": F.col("position").isNull() == F.col("reason").isNotNull(), "places": F.col("position").isNull() | (F.col("position") == F.col("_k")),
        "repeated chunk": F.col("_same") == 1, "too many": F.lit(True) if max_items is None else F.col("position").isNull() | (F.col("position") < max_items),
    })
