"""A store of vectors that lasts: batches of sorted Parquet files, and a manifest that says which of them count.

Folder: `data/<name of a batch>/` holds a batch's rows, ordered by chunk_id, so that lookups skip files and row groups by their statistics;
`manifest/<version>-.../` holds one JSON row for each change. A batch counts only once its manifest row is written, which is the last step:
a batch that is refused, or whose job is lost, leaves the store as it was (its files stay unread). One writer at a time; if two met, reading says so.
The manifest, one row a batch since the last `clear` or `compact`, is all that the driver reads.

Defined results: ids are strings; null ids, repeated ids, ids that the store has, null or empty vectors, null or non-finite components, zero vectors,
other lengths and other models than the store's (in an empty store: the batch's commonest; ties to the lesser) refuse the whole batch. An empty batch changes nothing.
Further columns are kept (null where a batch lacks them); one named `batch` is replaced by the number of the change that brought the row.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..operators.embedding import norm

#: Norms up to this are those of zero vectors (a fixed value).
ZERO = 1e-12
_MANIFEST = "version long, action string, path string, rows long, dimension int, model_name string, least string, largest string"


class Refused(ValueError):
    """A batch that breaks the store's rules; `problems` maps each broken rule to how many rows (or ids) break it."""

    def __init__(self, problems: dict[str, int]):
        super().__init__("batch refused: " + ", ".join(f"{name} ({n})" for name, n in sorted(problems.items())))
        self.problems = problems


def finite(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & ok, F.lit(False))


def batch_problems(batch: DataFrame, known: DataFrame | None = None, dimension: int | None = None, model: str | None = None) -> DataFrame:
    """(problem, n) of each rule that a batch (chunk_id, vector, model_name) breaks; empty if it is sound.

    `known` holds the chunk_ids that the store has. Repeated ids count once each. Only ids are shuffled.
    """
    usual = batch.agg(F.mode(F.when(finite(F.col("vector")), F.size("vector")), True), F.mode("model_name", True)).first() if dimension is None or model is None else (None, None)
    length, name = F.lit(usual[0] if dimension is None else dimension), F.lit(usual[1] if model is None else model)
    ok, whole = finite(F.col("vector")), F.col("chunk_id").isNotNull()
    rules = {
        "null id": ~whole, "not finite": ~ok, "zero vector": ok & (norm(F.col("vector")) <= ZERO), "another length": ok & (F.size("vector") != length),
        "another model": ~F.coalesce(F.col("model_name") == name, F.lit(False)),
    }
    counts = batch.agg(*[F.count_if(F.coalesce(broken, F.lit(False))).alias(f"_{k}") for k, broken in enumerate(rules.values())])
    found = counts.select(F.inline(F.array(*[F.struct(F.lit(rule).alias("problem"), F.col(f"_{k}").alias("n")) for k, rule in enumerate(rules)])))
    ids = batch.where(whole).select("chunk_id")
    found = found.union(ids.groupBy("chunk_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated id"), "n"))
    if known is not None:
        found = found.union(ids.distinct().join(known.select("chunk_id"), "chunk_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit("known id"), "n"))
    return found.where("n > 0")


@dataclass
class VectorStore:
    """An open store. Everything is read from the folder anew, so that any number of readers see what was committed."""

    spark: SparkSession
    folder: str

    @classmethod
    def create(cls, spark: SparkSession, folder: str) -> VectorStore:
        """A new, empty store in a folder that doesn't exist yet."""
        store = cls(spark, folder.rstrip("/"))
        spark.createDataFrame([(0, "create") + (None,) * 6], _MANIFEST).coalesce(1).write.mode("error").json(f"{store.folder}/manifest/0")
        return store

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).json(f"{self.folder}/manifest/*")

    def live(self, version: int | None = None) -> list:
        """The manifest rows of the batches that count, as of a version or now."""
        rows = [r for r in sorted(self.manifest().collect(), key=lambda r: r.version) if version is None or r.version <= version]
        if len({r.version for r in rows}) != len(rows):
            raise ValueError("two writers changed the store at once")
        start = max((k for k, r in enumerate(rows) if r.action != "add"), default=0)
        return [r for r in rows[start:] if r.path is not None]

    def _commit(self, action: str, path: str | None = None, about: tuple = (None,) * 5) -> int:
        version = self.manifest().agg(F.max("version")).first()[0] + 1
        row = self.spark.createDataFrame([(version, action, path, *about)], _MANIFEST)
        row.coalesce(1).write.mode("error").json(f"{self.folder}/manifest/{version}-{uuid.uuid4().hex}")
        return version

    def _write(self, rows: DataFrame) -> tuple[str, DataFrame, tuple]:
        path = f"data/{uuid.uuid4().hex}"
        rows.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.parquet(f"{self.folder}/{path}")
        staged = self.spark.read.parquet(f"{self.folder}/{path}")
        about = staged.agg(F.count("*"), F.max(F.size("vector")).cast("int"), F.max("model_name"), F.min("chunk_id"), F.max("chunk_id")).first()
        return path, staged, tuple(about)

    def add(self, batch: DataFrame) -> int:
        """Adds a batch (chunk_id, vector, model_name, ...) whole, or raises Refused; how many rows came in."""
        live = self.live()
        number = self.manifest().agg(F.max("version")).first()[0] + 1
        typed = {"chunk_id": F.col("chunk_id").cast("string"), "vector": F.col("vector").cast("array<double>"), "batch": F.lit(number).cast("long")}
        path, staged, about = self._write(batch.withColumns(typed))
        if not about[0]:
            return 0
        near = [r for r in live if about[3] is not None and r.least <= about[4] and about[3] <= r.largest]
        known = self._read(near).select("chunk_id") if near else None
        found = batch_problems(staged, known, live[0].dimension if live else None, live[0].model_name if live else None)
        problems = {r.problem: r.n for r in found.collect()}
        if problems:
            raise Refused(problems)
        self._commit("add", path, about)
        return about[0]

    def clear(self) -> None:
        """Empties the store, its length and model too; earlier versions can still be read."""
        self._commit("clear")

    def compact(self) -> None:
        """Writes all batches as one, sorted anew: rows and their batch numbers stay."""
        if len(self.live()) > 1:
            path, _, about = self._write(self.rows())
            self._commit("replace", path, about)

    def _read(self, entries: list) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.folder}/{r.path}" for r in entries])

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows, as of a version or now."""
        live = self.live(version)
        return self._read(live) if live else self.spark.createDataFrame([], "chunk_id string, vector array<double>, model_name string, batch long")

    def about(self) -> dict:
        """Rows, length and model of the store (both None while it is empty)."""
        live = self.live()
        return {"rows": sum(r.rows for r in live), "dimension": live[0].dimension if live else None, "model_name": live[0].model_name if live else None}

    def get(self, ids: list[str]) -> DataFrame:
        """The rows of a few ids: batches whose range holds none of them aren't opened, and files are skipped by their statistics."""
        live = [r for r in self.live() if any(r.least <= i <= r.largest for i in ids)]
        return (self._read(live) if live else self.rows().limit(0)).where(F.col("chunk_id").isin(*ids))

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The rows of any number of ids (chunk_id); ids that the store doesn't have are left out."""
        return self.rows().join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")

    def missing(self, ids: DataFrame) -> DataFrame:
        """The ids (chunk_id) that the store doesn't have."""
        return ids.select("chunk_id").distinct().join(self.rows().select("chunk_id"), "chunk_id", "left_anti")

    def search(self, queries: DataFrame, top_k: int = 5, least: float | None = None) -> DataFrame:
        """operators.search over the store's rows; a query of another length is an error."""
        if least is not None and not -1.0 <= least <= 1.0:
            raise ValueError("the least similarity lies outside [-1, 1]")
        length = self.about()["dimension"]
        if length is not None and queries.where(F.size("vector") != length).limit(1).count():
            raise ValueError("a query vector is of another length than the store's")
        return search.search(queries, self.rows().select("chunk_id", "vector"), top_k, least)
