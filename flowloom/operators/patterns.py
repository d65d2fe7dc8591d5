"""Many patterns or terms at once: an automaton compiled once and run over Arrow batches.

The automaton holds, for each domain pattern, the longest run of characters that stands in every match; a pass over a name finds all runs in it, and
only their patterns are then tried. Patterns without such a run (`*`, `??`) are tried on every name. Terms are looked for in whole texts.

Rule tables may be of any size: patterns are taken in blocks of at most BLOCK (nearly always one), by a hash, each compiled on the driver and sent out once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from fnmatch import translate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns of an automaton at most: about 100 MB.
BLOCK = 200_000


def anchor(pattern: str) -> str:
    """The longest run of characters that stands in all matches of a domain pattern, or an empty one."""
    body = pattern.removeprefix("*.")
    if "[]" in body or "[!]" in body:
        return ""
    plain = re.sub(r"\[[^]]*\]", "*", body)
    return "" if "[" in plain else max(re.split(r"[*?]", plain), key=len)


def tester(pattern: str):
    """What tells whether a name matches: `*.x` is x and all below it, any other is a glob."""
    if pattern.startswith("*."):
        return lambda name: name == pattern[2:] or name.endswith(pattern[1:])
    return re.compile(translate(pattern)).match


class Patterns:
    """Patterns by what has to stand in a name."""

    def __init__(self, patterns: list[str]):
        self.patterns = sorted(set(patterns))
        by: dict[str, list[int]] = {}
        for k, p in enumerate(self.patterns):
            by.setdefault(anchor(p), []).append(k)
        self.anywhere = by.pop("", [])
        self.automaton = ahocorasick.Automaton()
        for run, numbers in by.items():
            self.automaton.add_word(run, tuple(numbers))
        if by:
            self.automaton.make_automaton()
        self.tests: dict[int, object] = {}

    def __getstate__(self):
        return self.__dict__ | {"tests": {}}

    def matches(self, name: str) -> list[str]:
        found = set(self.anywhere)
        if len(self.automaton):
            found.update(k for _, numbers in self.automaton.iter(name) for k in numbers)
        out = []
        for k in sorted(found):
            test = self.tests.get(k)
            if test is None:
                test = self.tests[k] = tester(self.patterns[k])
            if test(name):
                out.append(self.patterns[k])
        return out


def _blocks(values: DataFrame) -> Iterator[list[str]]:
    """The distinct values (value), at most about BLOCK at a time."""
    distinct = values.where("value is not null").distinct()
    count = distinct.count()
    blocks = max(1, -(-count // BLOCK))
    for k in range(blocks):
        part = distinct if blocks == 1 else distinct.where(F.pmod(F.xxhash64("value"), F.lit(blocks)) == k)
        yield [r.value for r in part.collect()]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pattern_matches(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(name, pattern): each pattern that a name matches, of distinct non-empty names (name) and patterns (value), both without regard to case (in lower case)."""
    distinct = names.select(F.lower("name").alias("name")).where("name <> ''").distinct()
    spark, parts = names.sparkSession, []
    for block in _blocks(patterns.select(F.lower("value").alias("value"))):
        held = spark.sparkContext.broadcast(Patterns(block))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in batches:
                pairs = [(n, p) for n in batch.column("name").to_pylist() for p in known.matches(n)]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in pairs], pa.string()), pa.array([p for _, p in pairs], pa.string())], names=["name", "pattern"])

        parts.append(distinct.mapInArrow(run, "name string, pattern string"))
    return _union(parts)


def term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term, n): how often each term (value) stands in the text of each row (id, text), within words too, without regard to case; empty terms don't count.

    Occurrences of one term may overlap.
    """
    rows = texts.select("id", F.lower("text").alias("text"))
    id_type = rows.schema["id"].dataType
    spark, parts = texts.sparkSession, []
    for block in _blocks(terms.select(F.lower("value").alias("value"))):
        automaton = ahocorasick.Automaton()
        for t in block:
            if t:
                automaton.add_word(t, t)
        if len(automaton):
            automaton.make_automaton()
        held = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in batches:
                at, found, n = [], [], []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    for term, count in Counter(t for _, t in known.iter(text)).items() if text and len(known) else ():
                        at.append(k)
                        found.append(term)
                        n.append(count)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(n, pa.int64())], names=["id", "term", "n"])

        parts.append(rows.mapInArrow(run, f"id {id_type.simpleString()}, term string, n long"))
    return _union(parts)
