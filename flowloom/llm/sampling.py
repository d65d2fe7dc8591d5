"""Bounded samples of labelled rows for fitting small models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most; the same for every size of input.
SAMPLE_ROWS = 12_000
#: Strata that are sampled one by one, the most frequent first; all others are one stratum.
STRATA = 1_000


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """The rows, or the `most` of them with the least hashes if there are more: for what the driver is to get."""
    return rows if rows.count() <= most else rows.orderBy(F.xxhash64(F.lit(11), *rows.columns)).limit(most)


def sample(rows: DataFrame, strata: list[str], limit: int = SAMPLE_ROWS) -> DataFrame:
    """At most about `limit` of the rows, alike for each value of `strata`, chosen by a hash of all their values.

    Each stratum keeps a fraction limit / (strata * its rows); nothing is sorted and no group meets in one task. Rows without an id, and different rows of one id, are
    chosen one by one. Equal rows are chosen together: if that would give more than 5 / 4 of `limit`, or nothing of a table that isn't empty, the rows with the least
    hashes are taken instead, so the result is bounded whatever the rows are.
    """
    found = rows.groupBy(*strata).count()
    counts = [r.asDict() for r in found.orderBy(F.desc("count"), *strata).limit(STRATA).collect()]
    if not counts:
        return rows.limit(0)
    named = len(counts)
    if named == STRATA and (rest := rows.count() - sum(c["count"] for c in counts)):
        counts.append({"count": rest})
    share = limit / len(counts)
    spare = sum(max(0.0, share - c["count"]) for c in counts)  # small strata leave room to large ones
    wide = sum(1 for c in counts if c["count"] > share) or 1
    parts = [min(1.0, (share + spare / wide) / c["count"]) for c in counts]
    part = F.lit(parts[-1])
    for c, p in zip(counts[:named], parts):
        here = F.lit(True)
        for s in strata:
            here = here & F.col(s).eqNullSafe(F.lit(c[s]))
        part = F.when(here, p).otherwise(part)
    taken = rows.where(F.pmod(F.xxhash64(F.lit(7), *rows.columns), F.lit(1_000_003)) <= F.floor(part * 1_000_003))
    if not taken.limit(1).count():
        return bounded(rows, limit)
    return bounded(taken, limit + limit // 4)
