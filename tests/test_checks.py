"""Checks of other operators' rows."""

from flowloom.operators import checks, chunking


def test_chunks_are_made_once_to_be_checked(spark):
    rows = [("a", "One", "word " * 700), ("b", "Two", "short"), ("b", None, "no section"), (None, "Two", "no document"), ("c", "Gone", "line. " * 500)]
    sections = spark.createDataFrame(rows, "document_id string, section string, text string")
    made = chunking.chunks(sections)
    assert checks.chunk_problems(made).where("problem <> 'id'").count() == 0
    found = checks.chunk_problems(made, sections.where("section <> 'Gone'"), max_chars=1_000)
    number = {r[0]: r[1] for r in made.groupBy("section").count().collect()}
    got = {r.problem: r.n for r in found.collect()}
    assert got["unknown section"] == number["Gone"] + number[None] + 1 and got["too long"] == made.where("char_count > 1000").count() and "places" not in got
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    wrong = made.selectExpr("* except (chunk_count)", "if(section = 'One', chunk_count + 1, chunk_count) as chunk_count")
    assert {r.problem: r.n for r in checks.chunk_problems(wrong).collect()}["places"] == 1
    assert checks.chunk_problems(made.limit(0), sections).count() == 0
