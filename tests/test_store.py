"""The store of vectors: whole batches or none, reading back, lookups and versions."""

import pytest
from pyspark.sql import functions as F

from flowloom.operators import search
from flowloom.sources.store import Refused, VectorStore, batch_problems

ROW = "chunk_id string, vector array<double>, model_name string"


def made(spark, ids, model="m", extra=None):
    return spark.createDataFrame([(f"k{i:03d}", [float(i + 1), 1.0, float(i % 3)], model) for i in ids], ROW)


def test_batches_come_in_whole_and_are_read_back(spark, tmp_path):
    folder = str(tmp_path / "store")
    store = VectorStore.create(spark, folder)
    assert store.rows().count() == 0 and store.about() == {"rows": 0, "dimension": None, "model_name": None}
    assert store.add(made(spark, range(20)).withColumns({"section": F.lit("s"), "batch": F.lit("clash")})) == 20
    assert store.add(made(spark, range(20, 50))) == 30 and store.add(made(spark, [])) == 0
    again = VectorStore(spark, folder)
    rows = {r.chunk_id: r for r in again.rows().collect()}
    assert len(rows) == 50 and rows["k003"].vector == [4.0, 1.0, 0.0] and (rows["k003"].batch, rows["k030"].batch) == (1, 2) and (rows["k003"].section, rows["k030"].section) == ("s", None)
    assert again.about() == {"rows": 50, "dimension": 3, "model_name": "m"}
    assert {r.chunk_id for r in again.get(["k003", "k030", "x"]).collect()} == {"k003", "k030"} and again.get(["zz"]).count() == 0
    ids = spark.createDataFrame([("k001",), ("k001",), ("no",)], "chunk_id string")
    assert [r.chunk_id for r in again.lookup(ids).collect()] == ["k001"] and [r.chunk_id for r in again.missing(ids).collect()] == ["no"]
    asked = spark.createDataFrame([("q", [1.0, 2.0, 3.0])], "label string, vector array<double>")
    plain = search.search(asked, made(spark, range(50)).select("chunk_id", "vector"), 4)
    assert sorted(again.search(asked, 4).collect()) == sorted(plain.collect())
    with pytest.raises(ValueError, match="another length"):
        again.search(asked.withColumn("vector", F.slice("vector", 1, 2)))
    again.compact()
    assert len(store.live()) == 1 and {r.chunk_id: r.batch for r in store.rows().collect()} == {i: r.batch for i, r in rows.items()}
    assert store.rows(1).count() == 20
    store.clear()
    assert store.rows().count() == 0 and store.add(made(spark, range(3), "other")) == 3 and store.about()["model_name"] == "other"
    with pytest.raises(Exception, match="(?i)exist"):
        VectorStore.create(spark, folder)


def test_a_bad_row_leaves_the_store_as_it_was(spark, tmp_path):
    store = VectorStore.create(spark, str(tmp_path / "store"))
    store.add(made(spark, range(10)))
    fresh = made(spark, range(10, 30))
    bad = {
        "known id": made(spark, [5]), "repeated id": made(spark, [40, 40]), "another length": spark.createDataFrame([("a", [1.0], "m")], ROW), "another model": made(spark, [41], "other"), "null id": spark.createDataFrame([(None, [1.0, 2.0, 3.0], "m")], ROW),
        "zero vector": spark.createDataFrame([("a", [0.0, 0.0, 0.0], "m")], ROW), "not finite": spark.createDataFrame([("a", [1.0, float("nan"), 0.0], "m"), ("b", [1.0, None, 0.0], "m"), ("c", None, "m"), ("d", [], "m")], ROW),
    }
    for problem, rows in bad.items():
        with pytest.raises(Refused) as refused:
            store.add(fresh.union(rows))
        assert refused.value.problems == {problem: 4 if problem == "not finite" else 1}
        assert store.rows().count() == 10
    with pytest.raises(Refused):  # an empty store takes the commonest length and model
        VectorStore.create(spark, str(tmp_path / "new")).add(fresh.union(bad["another length"]))
    assert batch_problems(fresh).count() == 0 and store.add(fresh) == 20


def test_files_that_no_manifest_names_do_not_count(spark, tmp_path):
    store = VectorStore.create(spark, str(tmp_path / "store"))
    store.add(made(spark, range(4)))
    made(spark, range(4, 9)).write.parquet(str(tmp_path / "store" / "data" / "lost"))
    assert store.rows().count() == 4
    store.manifest().where("version = 1").coalesce(1).write.json(str(tmp_path / "store" / "manifest" / "1-other"))
    with pytest.raises(ValueError, match="two writers"):
        store.rows()


def test_lookups_push_their_ids_to_the_files(spark, tmp_path):
    store = VectorStore.create(spark, str(tmp_path / "store"))
    store.add(made(spark, range(10)))
    store.add(made(spark, range(10, 20)))
    found = store.get(["k012"])
    assert len(found.inputFiles()) < len(store.rows().inputFiles())
    assert "PushedFilters: [IsNotNull(chunk_id), EqualTo(chunk_id,k012)]" in found._jdf.queryExecution().toString() or "In(chunk_id" in found._jdf.queryExecution().toString()
