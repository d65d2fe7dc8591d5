"""Knowledge documents: Markdown files with front matter and fixed sections, in one folder for each category."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

PARSED = (
    StructType().add("meta", MapType(StringType(), StringType())).add("lists", MapType(StringType(), ArrayType(StringType()))).add("headings", ArrayType(StringType())).add("bodies", ArrayType(StringType())).add("problem", StringType())
)


def parse_front_matter(text: str) -> tuple[dict[str, str], dict[str, list[str]], str]:
    """(scalars, lists, rest) of a document. The front matter is `key: value`, or `key:` with `- item` lines; [] is an empty list; # starts a comment line."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[0].strip() != "---":
        raise ValueError("no front matter")
    try:
        end = next(k for k in range(1, len(lines)) if lines[k].strip() == "---")
    except StopIteration:
        raise ValueError("the front matter isn't closed") from None
    scalars: dict[str, str] = {}
    lists: dict[str, list[str]] = {}
    held = None
    for line in lines[1:end]:
        if "\t" in line:
            raise ValueError("a tab in the front matter")
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        item = re.match(r"\s+-\s+(.*)$|-\s+(.*)$", line)
        if item:
            if held is None:
                raise ValueError("an item without a key")
            lists[held].append(_bare(item[1] or item[2]))
            continue
        pair = re.match(r"([a-z_]+):\s*(.*)$", line)
        if not pair:
            raise ValueError(f"not a key: {line!r}")
        key, value = pair[1], pair[2].strip()
        if key in scalars or key in lists:
            raise ValueError(f"repeated key: {key}")
        held = None
        if value in ("", "[]"):
            lists[key] = []
            held = key if value == "" else None
        elif value.startswith("["):
            raise ValueError("a list on one line")
        else:
            scalars[key] = _bare(value)
    return scalars, lists, "\n".join(lines[end + 1 :])


def _bare(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def _parse(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        try:
            scalars, lists, rest = parse_front_matter(text or "")
            parts = re.split(r"(?m)^## +(.+?)[ \t]*$", rest)
            rows.append((scalars, lists, parts[1::2], [p.strip() for p in parts[2::2]], None))
        except ValueError as e:
            rows.append(({}, {}, [], [], str(e)))
    return pd.DataFrame(rows, columns=["meta", "lists", "headings", "bodies", "problem"])


def read_documents(spark: SparkSession, path: str, sections: list[str], categories: list[str]) -> DataFrame:
    """Files <path>/<category>/<id>.md -> id, category, title, version, lists, headings, bodies, sha256 and problem (null if sound)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    place = F.split("path", "/")
    parsed = F.pandas_udf(_parse, PARSED)(F.col("content").cast("string"))
    d = files.select(F.element_at(place, -2).alias("folder"), F.regexp_replace(F.element_at(place, -1), r"\.md$", "").alias("stem"), F.sha2("content", 256).alias("sha256"), parsed.alias("p"))
    m = F.col("p.meta")
    problem = (
        F.when(F.col("p.problem").isNotNull(), F.col("p.problem")).when(~F.col("folder").isin(*categories), "unknown category").when(~m["category"].eqNullSafe(F.col("folder")), "filed under another category")
        .when(~m["id"].eqNullSafe(F.col("stem")), "the file has another name than the document").when(~F.coalesce(m["id"].rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False)), "bad id")
        .when(~F.coalesce(m["version"].rlike(r"^\d+\.\d+(\.\d+)?$"), F.lit(False)), "bad version").when(F.col("p.headings") != F.array(*map(F.lit, sections)), "sections are missing, added or out of order")
        .when(F.exists("p.bodies", lambda b: b == ""), "an empty section")
    )
    return d.select(m["id"].alias("id"), "folder", m["title"].alias("title"), m["version"].alias("version"), F.col("p.lists").alias("lists"), F.col("p.headings").alias("headings"), F.col("p.bodies").alias("bodies"), "sha256", problem.alias("problem"))


def sections_of(documents: DataFrame) -> DataFrame:
    """document_id, category, title, section_index, section, text of the sound documents."""
    return documents.where("problem is null").select(F.col("id").alias("document_id"), F.col("folder").alias("category"), "title", F.posexplode(F.arrays_zip("headings", "bodies")).alias("section_index", "s")).select(
        "document_id", "category", "title", "section_index", F.col("s.headings").alias("section"), F.col("s.bodies").alias("text")
    )


def repeated_ids(documents: DataFrame) -> DataFrame:
    return documents.where("id is not null").groupBy("id").count().where("count > 1")
