"""Benchmark decontamination with suffix arrays over the training text.

Every task builds the suffix array of its shard of whole documents: all places where a word starts, in the order of the
words that follow up to the document's end (by prefix doubling). Each suffix of the benchmark is then
looked up by binary search: the two bounds of its window select all places where the window occurs verbatim, and
each such place is extended word by word to the longest match. Words are compared by 64-bit hashes.

The benchmark is written once, as word hashes, to BLOCK_WORDS blocks in the shared folder; a task searches one block after
another in the same suffix array. So neither driver nor task holds a whole benchmark, and results don't depend on its size.

Defined results: null and empty texts have no words and are never contaminated; items without words have no window; items that
share an id are each searched and listed once; an item without an id marks words as hit, but isn't listed; a document row
is judged by itself, whatever its id, so repeated rows get equal results; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, hash_words, lean, shared_dir, steps, words

WINDOW = 13
#: Words of benchmark items that are searched at once.
BLOCK_WORDS = 1 << 20
#: Bytes of text that one suffix array spans.
SHARD = 4 << 20

MATCH = "doc_id long, doc_word long, item_id long, item_word long, n_words long"
_HELD: dict[str, tuple] = {}


class SuffixArray:
    """The suffix array of a shard: word hashes, 0 after each document (no word has the hash 0)."""

    def __init__(self, text: np.ndarray, depth: int):
        """depth: how many words count at most; longer common beginnings stay in the order of the text."""
        n = len(text)
        self.text = text
        ends = np.flatnonzero(text == 0)
        self.room = (np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(n)).astype(np.int32)  # a shard has far fewer than 2^31 words; words to the document's end
        at = np.flatnonzero(text)
        at = at[np.argsort(text[at], kind="stable")].astype(np.int32)
        rank = np.zeros(n, np.int32)  # a suffix's rank is the place at which its group of equal ones starts, from 1; 0: beyond the end
        new = np.append(True, text[at][1:] != text[at][:-1])[: len(at)]
        rank[at] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
        self.at, h = at, 1
        alike = np.flatnonzero(~(new & np.append(new[1:], True)[: len(at)]))
        while len(alike) and h < depth:
            some = at[alike]
            after = np.where(self.room[some] > h, rank[np.minimum(some + h, n - 1)], 0)
            order = np.lexsort((after, rank[some]))
            some, after, group = some[order], after[order], rank[some][order]
            at[alike] = some
            new = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
            rank[some] = (alike + 1)[np.flatnonzero(new)[np.cumsum(new) - 1]]
            # Groups of one are settled, and so are those that reach the end of their documents.
            alike, h = alike[~(new & np.append(new[1:], True)) & (after > 0)], 2 * h

    def bound(self, item: np.ndarray, start: np.ndarray, size: np.ndarray, beyond: bool) -> np.ndarray:
        """For each run item[start : start + size] the number of suffixes before it (or, if `beyond`, before or beginning with it)."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.at), np.int64)
        go = np.arange(len(start)) if len(self.at) else np.empty(0, int)
        while len(go):
            middle = (low[go] + high[go]) >> 1
            after = self._before(self.at[middle], item, start[go], size[go], beyond)
            low[go] = np.where(after, middle + 1, low[go])
            high[go] = np.where(after, high[go], middle)
            go = go[low[go] < high[go]]
        return low

    def _before(self, place: np.ndarray, item: np.ndarray, start: np.ndarray, size: np.ndarray, equal: bool) -> np.ndarray:
        """Whether each suffix stands before its run; `equal` is the answer where it begins with the run."""
        out, go = np.full(len(place), equal), np.arange(len(place))
        for k in range(int(size.max(initial=0))):
            go = go[size[go] > k]
            a, b = self.text[place[go] + k], item[start[go] + k]
            out[go[a < b]], out[go[a > b]] = True, False
            go = go[a == b]
            if not len(go):
                break
        return out


class Block:
    """Some benchmark items: word hashes in a row, and the windows."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        hashed = [np.frombuffer(w, np.uint64) for _, w in items]
        size = np.array([len(h) for h in hashed], np.int64)
        self.item_ids = [i for i, _ in items]
        self.words = np.concatenate(hashed) if hashed else np.empty(0, np.uint64)
        self.first = np.cumsum(size) - size
        self.longest = int(size.max(initial=0))
        width = np.minimum(size, WINDOW)
        count = np.where(size > 0, size - width + 1, 0)
        self.owner = np.repeat(np.arange(len(items)), count)
        self.offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.size = width[self.owner]
        self.start = self.first[self.owner] + self.offset
        self.end = (self.first + size)[self.owner]

    def occurrences(self, array: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the shard, window) of every occurrence."""
        low = array.bound(self.words, self.start, self.size, beyond=False)
        # Most windows don't occur; only for those that do the other bound is looked for.
        seen = np.flatnonzero(low < len(array.at))
        there = array.at[low[seen]]
        seen = seen[self._same(array, there, self.start[seen], self.size[seen])]
        count = array.bound(self.words, self.start[seen], self.size[seen], beyond=True) - low[seen]
        window = np.repeat(seen, count)
        return array.at[np.repeat(low[seen] - np.cumsum(count) + count, count) + np.arange(len(window))], window

    def _same(self, array: SuffixArray, place: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        same = array.room[place] >= size
        for k in range(WINDOW):
            go = np.flatnonzero(same & (size > k))
            same[go] = array.text[place[go] + k] == self.words[start[go] + k]
        return same

    def extend(self, array: SuffixArray, place: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, window, words) of the longest matches: occurrences that can't begin a word earlier, with all words that follow alike."""
        back = (self.offset[window] > 0) & (place > 0)
        where = np.flatnonzero(back)
        back[where] = array.text[place[where] - 1] == self.words[self.start[window[where]] - 1]
        place, window = place[~back], window[~back]
        size, go = self.size[window].copy(), np.arange(len(place))
        while len(go):
            go = go[(self.start[window[go]] + size[go] < self.end[window[go]]) & (array.room[place[go]] > size[go])]
            go = go[array.text[place[go] + size[go]] == self.words[self.start[window[go]] + size[go]]]
            size[go] += 1
        return place, window, size


def write_blocks(benchmark: DataFrame, path: str) -> int:
    """Writes (item_id, word hashes) of the distinct items to the folders block=0, 1, ...; how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for whole in batches:
            for batch in steps(whole, "text"):
                hashed = [hash_words(words(t), cache).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(hashed, pa.binary())], names=["item_id", "words"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    hashed = items.mapInArrow(lean(run), "item_id long, words binary").where("length(words) > 0").distinct()
    total = hashed.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    blocks = int(total // BLOCK_WORDS) + 1
    hashed.withColumn("block", F.pmod(F.xxhash64("words", "item_id"), F.lit(blocks)).cast("int")).repartition(blocks, "block").write.mode("overwrite").partitionBy("block").parquet(path)
    return blocks


def _read_block(path: str, number: int) -> Block:
    """A block, from the shared folder; a worker keeps the one that it read last."""
    key = f"{path}/block={number}"
    if key not in _HELD:
        _HELD.clear()
        fs, folder = pa.fs.FileSystem.from_uri(key) if "://" in key else (pa.fs.LocalFileSystem(), key.removeprefix("file:"))
        files = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".parquet"))
        found = [r for f in files for r in pq.ParquetFile(fs.open_input_file(f)).read(["item_id", "words"]).to_pylist()]
        _HELD[key] = Block([(r["item_id"], r["words"]) for r in found])
    return _HELD[key]


def _shards(batches: Iterator[pa.RecordBatch], path: str, blocks: int):
    """For each shard: its rows, the place of each one's first word, how many each has, the suffix array, and the blocks in turn."""
    cache = WordHashes()
    for whole in batches:
        for batch in steps(whole, "text", SHARD):
            found = [hash_words(words(t), cache) for t in batch.column("text").to_pylist()]
            size = np.array([len(f) for f in found], np.int64)
            end = np.zeros(1, np.uint64)
            text = np.concatenate([x for f in found for x in (np.maximum(f, 1), end)])
            depth = max(WINDOW, _read_block(path, 0).longest) if blocks == 1 else WINDOW
            yield batch, np.cumsum(size + 1) - size - 1, size, SuffixArray(text, depth), (_read_block(path, b) for b in range(blocks))


def _hits(path: str, blocks: int, listed: bool) -> Callable:
    """Judges shards: (batch, words, hit words, ids of the items that occur, or None unless `listed`) of each."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, start, size, array, read in _shards(batches, path, blocks):
            edge = np.zeros(len(array.text) + 1, np.int64)
            items: list[set] = [set() for _ in range(len(start))]
            for block in read:
                at, window = block.occurrences(array)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + block.size[window], -1)
                if listed and len(at):
                    row = np.searchsorted(start, at, "right") - 1
                    for r, k in np.unique(np.stack([row, block.owner[window]], 1), axis=0).tolist():
                        if block.item_ids[k] is not None:
                            items[r].add(str(block.item_ids[k]))
            hit = np.append(0, np.cumsum(np.cumsum(edge)[:-1] > 0))
            yield batch, size, hit[start + size] - hit[start], items if listed else None

    return run


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, work: str | None = None) -> DataFrame:
    """Maximal verbatim matches of at least a window: doc_id, doc_word, item_id, item_word, n_words (places count words from 0)."""
    path = work or shared_dir(docs.sparkSession)
    blocks = write_blocks(benchmark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start, _, array, read in _shards(batches, path, blocks):
            for block in read:
                at, window, n = block.extend(array, *block.occurrences(array))
                row = np.searchsorted(start, at, "right") - 1
                ids = pa.array([block.item_ids[k] for k in block.owner[window]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(at - start[row]), ids, pa.array(block.offset[window]), pa.array(n)], names=[c.split()[0] for c in MATCH.split(", ")])

    return _input(docs).mapInArrow(lean(run), MATCH)


def contamination(docs: DataFrame, benchmark: DataFrame, work: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids as strings, sorted), contaminated."""
    path = work or shared_dir(docs.sparkSession)
    judge = _hits(path, write_blocks(benchmark, path), listed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n, hit, items in judge(batches):
            listed = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(hit), listed], names=["doc_id", "n_words", "n_hit", "items"])

    judged = _input(docs).mapInArrow(lean(run), "doc_id long, n_words long, n_hit long, items array<string>")
    return judged.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def digest(judged: DataFrame) -> DataFrame:
    """The columns of the contract: the items' ids become a count and a SHA-256."""
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, work: str | None = None) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns; rows are judged one by one."""
    path = work or shared_dir(docs.sparkSession)
    judge = _hits(path, write_blocks(benchmark, path), listed=False)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n, hit, _ in judge(batches):
            yield batch.filter(pa.array(~((hit > 0) & (20 * hit >= n))))

    return docs.mapInArrow(lean(keep), T.StructType(docs.schema.fields))
