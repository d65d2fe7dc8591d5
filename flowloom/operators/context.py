"""Context blocks: ranked chunks under a budget, rendered with their sources, and checks on what cites them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import neutral_fences

MAX_ITEMS, MAX_CHARS, MAX_TOKENS = 4, 3000, 900


def rendered(ref: Column) -> Column:
    """An excerpt as it stands in a block; needs document_id, section, category, similarity, citation, matched and text."""
    matched = F.when(F.size("matched") > 0, F.array_join("matched", ", ")).otherwise("none")
    lines = [
        F.concat(F.lit("["), ref, F.lit("]")), F.concat(F.lit("Document: "), "document_id"), F.concat(F.lit("Section: "), "section"), F.concat(F.lit("Category: "), "category"),
        F.concat(F.lit("Similarity: "), F.format_string("%.4f", "similarity")), F.concat(F.lit("Citation: "), "citation"), F.concat(F.lit("Matched signals: "), matched), F.lit("Text:"), neutral_fences(F.col("text")),
    ]
    return F.concat_ws("\n", *lines)


def fit_budget(ranked: DataFrame, max_items: int | str | None = MAX_ITEMS, max_chars: int | str | None = MAX_CHARS, max_tokens: int | str | None = MAX_TOKENS, overhead: int = 0, by: str = "capture", per_item: int = 2) -> DataFrame:
    """Walks each group's excerpts by rank and takes those that still fit; one that doesn't is passed over, not the end.

    ranked: (by, rank, chunk_id, size), a few rows a group as retrieval has capped it. size is that of the excerpt without its number; an excerpt's label counts too, and `per_item`
    separates it from the one before. A limit may also name a column that is the same throughout a group (null: no limit). Gives chunk_id, position (null if left out) and the limit that was hit first.
    """
    named = {k: v for k, v in (("_items", max_items), ("_chars", max_chars), ("_tokens", max_tokens)) if isinstance(v, str)}
    most = lambda k, v: F.col(k) if k in named else F.lit(2**31 - 1 if v is None else v)
    start = F.struct(F.lit(0).alias("n"), F.lit(overhead).cast("long").alias("used"), F.array().cast("array<struct<chunk_id:string,position:int,reason:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        size = x["size"].cast("long") + F.length((s["n"] + 1).cast("string")) + F.when(s["n"] > 0, per_item).otherwise(0)
        total = s["used"] + size
        reason = F.when(s["n"] >= most("_items", max_items), "max_items").when(total > most("_chars", max_chars), "max_chars").when(F.ceil(total / 3.5) > most("_tokens", max_tokens), "max_tokens")
        took = reason.isNull()
        row = F.struct(x["chunk_id"].alias("chunk_id"), F.when(took, s["n"]).cast("int").alias("position"), reason.cast("string").alias("reason"))
        return F.struct((s["n"] + took.cast("int")).alias("n"), F.when(took, total).otherwise(s["used"]).alias("used"), F.concat(s["out"], F.array(row)).alias("out"))

    groups = ranked.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("chunk_id"), "size"))).alias("items"), *[F.coalesce(F.max(v), F.lit(2**31 - 1)).alias(k) for k, v in named.items()])
    return groups.select(by, F.aggregate("items", start, step).alias("s")).select(by, F.inline("s.out"))


def render_block(taken: DataFrame, by: str = "capture") -> DataFrame:
    """One row per group: the block's text and its size."""
    items = taken.withColumn("_text", rendered(F.concat(F.lit("K"), (F.col("position") + 1).cast("string"))))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "_text"))), lambda x: x["_text"]), "\n\n")
    return items.groupBy(by).agg(text.alias("text")).withColumns({"chars": F.length("text"), "tokens": F.ceil(F.length("text") / 3.5).cast("long")})


def unknown_references(cited: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """References in answers that nothing supplied bears."""
    return cited.join(known, by, "left_anti")


def render_records(records: DataFrame, columns: list[str]) -> DataFrame:
    """Each capture's records as lines of cells: a head line, then one for each flow; true is 1, null is empty, bars and backslashes are escaped."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.when(F.col(c).cast("string") == "true", "1").when(F.col(c).cast("string") == "false", "0").otherwise(F.col(c).cast("string")), F.lit("")), r"([\\|])", r"\\$1")
    line = F.concat_ws("|", *[cell(c) for c in sorted(columns)])
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("flow_id", line.alias("line")))), lambda x: x["line"]), "\n")
    return records.groupBy("capture").agg(F.concat(F.lit("|".join(sorted(columns)) + "\n"), body).alias("text"))


def request_tokens(parts: list[Column], schema: int = 0) -> Column:
    """An estimate of a request's size: each message's, and four for its frame, and the schema's."""
    return sum((F.ceil(F.length(p) / 3.5) + 4 for p in parts[1:]), F.ceil(F.length(parts[0]) / 3.5) + 4) + F.lit(schema)
