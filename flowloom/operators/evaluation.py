"""Ranked-retrieval metrics, and the rules that accept a configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .context import MAX_CHARS, MAX_ITEMS, MAX_TOKENS, fit_budget

KS = (1, 3, 5, 8)
FAILING_TOKENS = 7240

# The settings that are compared, against the first; the last only shows the ceiling and is never chosen.
CANDIDATES = [
    {"name": "baseline", "per_query": 4, "final_k": 8, "per_document": 2, "least": None, "max_items": 4, "max_chars": 3000, "max_tokens": 900},
    {"name": "A", "per_query": 6, "final_k": 8, "per_document": 1, "least": 0.75, "max_items": 4, "max_chars": 3000, "max_tokens": 900},
    {"name": "B", "per_query": 6, "final_k": 8, "per_document": 1, "least": 0.75, "max_items": 6, "max_chars": 6000, "max_tokens": 1200},
    {"name": "C", "per_query": 6, "final_k": 8, "per_document": 1, "least": 0.75, "max_items": 4, "max_chars": 6000, "max_tokens": 1200},
    {"name": "D", "per_query": 6, "final_k": 8, "per_document": 1, "least": 0.75, "max_items": 6, "max_chars": 4000, "max_tokens": 1200},
    {"name": "D-partial", "per_query": 6, "final_k": 8, "per_document": 2, "least": None, "max_items": 4, "max_chars": 4000, "max_tokens": 1200},
    {"name": "D-items4", "per_query": 6, "final_k": 8, "per_document": 1, "least": 0.75, "max_items": 4, "max_chars": 4000, "max_tokens": 1200},
    {"name": "D-mpd2", "per_query": 6, "final_k": 8, "per_document": 2, "least": 0.75, "max_items": 6, "max_chars": 4000, "max_tokens": 1200},
    {"name": "D-nofloor", "per_query": 6, "final_k": 8, "per_document": 1, "least": None, "max_items": 6, "max_chars": 4000, "max_tokens": 1200},
    {"name": "A2", "per_query": 6, "final_k": 8, "per_document": None, "least": 0.75, "max_items": 4, "max_chars": 3000, "max_tokens": 900},
    {"name": "unbounded", "per_query": 6, "final_k": 8, "per_document": 1, "least": 0.75, "max_items": 99, "max_chars": 1000000, "max_tokens": None},
]
REFERENCE_ONLY = ("unbounded",)


def deduplicated(ranking: DataFrame, by: list[str], item: str = "item") -> DataFrame:
    """The first place of each item, ranked anew from 1."""
    first = ranking.groupBy(*by, item).agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("rank", item)))


def metrics(ranking: DataFrame, relevant: DataFrame, by: list[str], ks: tuple[int, ...] = KS, item: str = "item") -> DataFrame:
    """hit, recall, precision at each k, and the reciprocal rank over the whole list, of each case.

    Precision is over what was returned. A case without relevant items, or (for precision) without results, has null.
    """
    r = deduplicated(ranking, by, item).join(relevant.select(*by, item).distinct().withColumn("_rel", F.lit(1)), [*by, item], "left")
    return judged_metrics(r.withColumn("found", F.col("_rel").isNotNull()), relevant.groupBy(*by).agg(F.countDistinct(item).alias("relevant")), by, ks)


def judged_metrics(judged: DataFrame, size: DataFrame, by: list[str], ks: tuple[int, ...] = KS) -> DataFrame:
    """The same of rankings without repeats (by, rank, found: whether the item is relevant) and how many items are relevant (by, relevant).

    For cases with many relevant items: nothing grows with their pairs.
    """
    at = [x for k in ks for x in (F.count_if((F.col("rank") <= k) & F.col("found")).alias(f"found_{k}"), F.count_if(F.col("rank") <= k).alias(f"returned_{k}"))]
    m = judged.groupBy(*by).agg(*at, F.min(F.when(F.col("found"), F.col("rank"))).alias("first")).join(size, by, "full")
    known = F.col("relevant") > 0
    out = [F.when(known, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank")]
    for k in ks:
        found = F.coalesce(F.col(f"found_{k}"), F.lit(0))
        out += [
            F.when(known, (found > 0).cast("double")).alias(f"hit_{k}"), F.when(known, found / F.col("relevant")).alias(f"recall_{k}"),
            F.when(known & (F.col(f"returned_{k}") > 0), found / F.col(f"returned_{k}")).alias(f"precision_{k}"),
        ]
    return m.select(*by, *out)


def means(per_case: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Means over the cases that have the value, and how many those are."""
    grouped = per_case.groupBy(*by) if by else per_case
    return grouped.agg(*[F.avg(c).alias(c) for c in columns], F.count_if(F.coalesce(*columns).isNotNull()).alias("cases"))


def set_differences(expected: DataFrame, found: DataFrame, by: list[str], item: str) -> DataFrame:
    """(by, item, kind): missing (expected only), additional (found only) or correct."""
    e = expected.select(*by, item).distinct().withColumn("_e", F.lit(1))
    f = found.select(*by, item).distinct().withColumn("_f", F.lit(1))
    kind = F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "additional").otherwise("correct")
    return e.join(f, [*by, item], "full").select(*by, item, kind.alias("kind"))


def accounts(cases: DataFrame) -> DataFrame:
    """What happened to each case's labelled documents: relevant, irrelevant, retrieved and supplied are arrays; tokens are counts."""
    supplied = F.size(F.array_intersect("relevant", "supplied"))
    return cases.select(
        "*", F.sort_array(F.array_except("relevant", "retrieved")).alias("never_retrieved"), F.sort_array(F.array_except(F.array_intersect("relevant", "retrieved"), F.col("supplied"))).alias("lost_before_prompt"),
        F.sort_array(F.array_intersect("irrelevant", "supplied")).alias("irrelevant_supplied"), F.when(F.size("relevant") > 0, supplied / F.size("relevant")).alias("supplied_recall"),
        F.when(F.size("supplied") > 0, supplied / F.size("supplied")).alias("supplied_precision"),
        F.when(F.col("prompt_tokens") > 0, (F.col("prompt_tokens") - F.col("capture_tokens")) / F.col("prompt_tokens")).otherwise(0.0).alias("knowledge_share"),
        (F.col("prompt_tokens") + F.col("alongside_tokens") >= FAILING_TOKENS).alias("at_risk"),
    )


def candidates(case_accounts: DataFrame) -> DataFrame:
    """The totals of each candidate over its cases."""
    t = case_accounts.groupBy("candidate").agg(
        F.avg("supplied_recall").alias("recall"), F.avg("supplied_precision").alias("precision"), F.sum(F.size("irrelevant_supplied")).alias("irrelevant"),
        F.max(F.col("prompt_tokens") + F.col("alongside_tokens")).alias("largest"),
    )
    return t.withColumn("per_1k_tokens", F.when(F.col("largest") > 0, 1000.0 * F.col("recall") / F.col("largest")))


def admissible(totals: DataFrame, baseline: str, reference: tuple[str, ...] = REFERENCE_ONLY) -> DataFrame:
    """Whether each candidate may replace the baseline: recall kept, no more irrelevant documents, no growth into sizes that fail; ranked by recall per 1000 tokens.

    Those in `reference` never may. Means are compared to nine places, so that the order of their sums doesn't rank them.
    """
    b = totals.where(F.col("candidate") == baseline).first()
    t = totals.where(F.col("candidate") != baseline)
    base = lambda c: F.lit(b[c] if b else None)
    fits = (F.col("largest") < FAILING_TOKENS) | (base("largest") >= FAILING_TOKENS)
    ok = F.coalesce((F.col("recall") + 1e-9 >= base("recall")) & (F.col("irrelevant") <= base("irrelevant")) & fits & ~F.col("candidate").isin(*reference), F.lit(False))
    order = Window.partitionBy("ok").orderBy(F.bround("per_1k_tokens", 9).desc(), F.bround("precision", 9).desc_nulls_last(), "largest", F.desc("candidate"))
    return t.withColumn("ok", ok).withColumn("place", F.when(F.col("ok"), F.row_number().over(order)))


def decision(before: DataFrame, after: DataFrame) -> DataFrame:
    """accept or reject of a change, from one-row tables (recall, precision, irrelevant): no precision may be lost, nor more than 0.05 of recall."""
    a = after.first()
    dr, dp, di = (F.lit(a[c]) - F.col(c) for c in ("recall", "precision", "irrelevant"))
    verdict = F.when(dr.isNull() | dp.isNull(), "undecided").when((dp < 0) | (di > 0) | (dr < -0.05) | ((dr <= 0) & (dp <= 0) & (di == 0)), "reject").otherwise("accept")
    return before.select(verdict.alias("verdict"), F.bround(dr, 4).alias("recall_delta"), F.bround(dp, 4).alias("precision_delta"), di.alias("irrelevant_delta"))


_SETTING = "struct<setting:string,per_query:int,final_k:int,per_document:int,least:double,max_items:int,max_chars:int,max_tokens:int>"
_DEFAULTS = {"per_query": None, "final_k": 8, "per_document": 2, "least": None, "max_items": MAX_ITEMS, "max_chars": MAX_CHARS, "max_tokens": MAX_TOKENS}


def by_settings(rows: DataFrame, grid: list[dict]) -> DataFrame:
    """Each row once for every setting: the columns of a grid's settings beside it. A grid is a few dicts (name, and what differs from the defaults; None is no limit)."""
    for s in grid:
        if set(s) - {"name", *_DEFAULTS}:
            raise ValueError(f"unknown parts of a setting: {sorted(set(s) - {'name', *_DEFAULTS})}")
    if not grid or len({s["name"] for s in grid}) != len(grid):
        raise ValueError("settings need different names")
    settings = [F.struct(*[F.lit(v) for v in (s["name"], *({**_DEFAULTS, **s}[k] for k in _DEFAULTS))]) for s in grid]
    return rows.withColumn("_s", F.explode(F.array(*settings).cast(f"array<{_SETTING}>"))).select("*", "_s.*").drop("_s")


def chosen_by_settings(merged: DataFrame, by: list[str]) -> DataFrame:
    """search.select_chunks of all settings at once: (setting, by, chunk_id, ...) under each setting's floor, document cap and size; rank from 0.

    merged: rows of by_settings with chunk_id, document_id, similarity. Two windows over (setting, by), whatever the number of settings.
    """
    best = [F.bround("similarity", 12).desc(), "chunk_id"]
    kept = merged.where(F.col("least").isNull() | (F.col("similarity") >= F.col("least")))
    same = kept.withColumn("_d", F.row_number().over(Window.partitionBy("setting", *by, "document_id").orderBy(*best)))
    capped = same.where(F.col("per_document").isNull() | (F.col("_d") <= F.col("per_document"))).drop("_d")
    return capped.withColumn("rank", F.row_number().over(Window.partitionBy("setting", *by).orderBy(*best)) - 1).where(F.col("rank") < F.col("final_k"))


def sweep(merged: DataFrame, relevant: DataFrame, grid: list[dict], by: list[str]) -> DataFrame:
    """Mean recall and precision of each setting of a grid, over one ranking read once: every setting only filters and caps it anew.

    merged: (by, chunk_id, document_id, similarity); relevant: (by, item).
    """
    chosen = chosen_by_settings(by_settings(merged, grid), by)
    ranking = chosen.select("setting", *by, F.col("document_id").alias("item"), (F.col("rank") + 1).alias("rank"))
    whole = max(s.get("final_k", _DEFAULTS["final_k"]) for s in grid)
    wanted = by_settings(relevant.select(*by, "item"), grid)
    m = metrics(ranking, wanted, ["setting", *by], (whole,))
    return means(m, [f"recall_{whole}", f"precision_{whole}"], ["setting"]).select("setting", F.col(f"recall_{whole}").alias("recall"), F.col(f"precision_{whole}").alias("precision"), "cases")


def candidate_cases(hits: DataFrame, labels: DataFrame, grid: list[dict], by: str) -> DataFrame:
    """What each setting retrieves and supplies in each case, as `accounts` takes it: (candidate, by, relevant, irrelevant, retrieved, supplied, supplied_chars).

    hits: (by, label, chunk_id, document_id, similarity, rank from 0, size), the hits of a case's queries; labels: (by, document_id, relevant). A setting
    takes its first `per_query` hits of each query, merges them by chunk, floors and caps them, and walks the budget. Hits are read once, whatever the settings.
    Cases without hits come with empty lists; documents are named once, in order. retrieved and supplied hold at most final_k documents.
    """
    deepest = [s.get("per_query") for s in grid]
    first = hits if None in deepest else hits.where(F.col("rank") < max(deepest))
    taken = by_settings(first, grid).where(F.col("per_query").isNull() | (F.col("rank") < F.col("per_query")))
    limits = ["final_k", "per_document", "least", "max_items", "max_chars", "max_tokens"]
    merged = taken.groupBy("setting", *limits, by, "chunk_id", "document_id").agg(F.max("similarity").alias("similarity"), F.max("size").alias("size"))
    chosen = chosen_by_settings(merged, [by]).withColumn("_case", F.struct("setting", by))
    placed = fit_budget(chosen, "max_items", "max_chars", "max_tokens", by="_case").select("_case.*", "chunk_id", "position")
    both = chosen.select("setting", by, F.col("chunk_id").cast("string").alias("chunk_id"), "document_id", "size").join(placed, ["setting", by, "chunk_id"])
    inside = F.col("position").isNotNull()
    found = both.groupBy("setting", by).agg(
        F.array_sort(F.collect_set("document_id")).alias("retrieved"), F.array_sort(F.collect_set(F.when(inside, F.col("document_id")))).alias("supplied"), F.sum(F.when(inside, F.col("size")).otherwise(0)).alias("supplied_chars"),
    )
    of = lambda wanted: F.array_sort(F.collect_set(F.when(wanted, F.col("document_id"))))
    cases = by_settings(labels.groupBy(by).agg(of(F.col("relevant")).alias("relevant"), of(~F.col("relevant")).alias("irrelevant")), grid).drop(*_DEFAULTS)
    none = F.array().cast(found.schema["retrieved"].dataType)
    listed = [F.coalesce(c, none).alias(c) for c in ("retrieved", "supplied")]
    return cases.join(found, ["setting", by], "left").select(F.col("setting").alias("candidate"), by, "relevant", "irrelevant", *listed, F.coalesce("supplied_chars", F.lit(0)).cast("long").alias("supplied_chars"))


def recommended(swept: DataFrame, least_recall: float) -> DataFrame:
    """The setting with the best precision among those that keep the recall."""
    return swept.where(F.col("recall") >= least_recall).agg(F.max_by("setting", F.struct("precision", "recall")).alias("setting"))
