import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FUNCTION_WORDS = {"en": "the of and to in is that for".split(), "de": "der die und das von mit ist ein".split(), "es": "el la de que los las por una".split(), "fr": "le les des est dans pour une que".split()}
SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ung ich ein keit auf ver ge lich".split(), "es": "ción mente ado ida os as que rra ll".split(), "fr": "eau oi ent eux ai elle tion ou".split()}


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    words = [rng.choice(FUNCTION_WORDS[lang]) if rng.random() < 0.4 else "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + "," if k % 11 == 3 else w for k, w in enumerate(words)) + "."


@pytest.fixture(scope="session")
def corpus(spark):
    """(documents, benchmark, labels) as lists of rows: prose, copies, near copies, benchmark passages, insults, junk."""
    rng = random.Random(4)
    items = [(k, prose(rng, 30)) for k in range(5)] + [(5, "only five words stand here"), (6, ""), (7, None)]
    docs, labels = [], []
    for k in range(160):
        lang = ["en", "en", "de", "es", "fr"][k % 5]
        text = prose(rng, rng.randint(40, 160), lang)
        toxic = int(k % 8 == 1)
        bad = int(k % 9 == 4)
        if toxic:
            words = text.split(" ")
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["stupid", "moron", "idiot"]))
            text = " ".join(words)
        if bad:
            text = " ".join(w + rng.choice(["&&&", "***", "%%%"]) for w in text.split(" "))
        docs.append((k, text, lang, f"src{k % 3}", len(text)))
        labels.append((k, 1 - bad, toxic))
    for k in range(160, 176):  # exact copies, near copies
        text = docs[k - 160][1]
        if k % 2:
            words = text.split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        docs.append((k, text, docs[k - 160][2], "copy", len(text)))
    for k in range(176, 180):
        text = prose(rng, 20) + " " + items[k - 176][1] + " " + prose(rng, 30)
        docs.append((k, text, "en", "leak", len(text)))
    docs.append((180, "Only FIVE words, stand here!", "en", "leak", 28))
    return docs, items, labels


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeats, ties and columns with clashing names."""
    long = "word " * 30_000
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "!!! ???"), (5, "one"), (6, "one"), (7, long), (8, long), (5, "one"), (None, "one two three"), (9, "x" * 5000), (10, "ÄÖÜ 日本語 😀 \u0000 ▁ a\tb"), (11, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    return frame.select("*", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit(k).alias(k) for k in ("a", "b", "text_a", "text_b", "sig", "key", "rep", "component", "block", "bucket", "chunk", "file", "rank", "score", "class_id")])


@pytest.fixture(scope="session")
def folder(spark, corpus, tmp_path_factory):
    """The corpus as the driver's tables."""
    docs, items, labels = corpus
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)
