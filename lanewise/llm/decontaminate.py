"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

The benchmark is taken in blocks of bounded size. For each block one pass over the documents
counts in how many of them each n-gram of the block's items occurs, and a second one looks up the
items' rare n-grams and aligns the words around each hit with the item. Texts never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import mix64, words_of

MATCH, MISMATCH, GAP = 2, -1, 1
LONG_COPY = 13  # equal words that are a copy in an item of any length: chance does not reach them


@dataclass
class Block:
    """Items of one block as word numbers, and their n-grams: key, item and place in the item."""

    n: int
    item_ids: list[int] = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)
    numbers: dict[bytes, int] = field(default_factory=dict)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, rows: list[tuple[int, str]], n: int) -> Block:
        block = cls(n)
        keys, item, place = [], [], []
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([block.numbers.setdefault(w, len(block.numbers) + 1) for w in words])
            found = block.grams(ids, min(n, len(ids)))
            keys.append(found)
            item.append(np.full(len(found), len(block.items)))
            place.append(np.arange(len(found)))
            block.item_ids.append(item_id)
            block.items.append(ids)
        if keys:
            block.keys, block.item, block.place = map(np.concatenate, (keys, item, place))
            block.only(np.arange(len(block.keys)))
        return block

    def only(self, chosen: np.ndarray) -> None:
        """Keep the chosen n-grams, in key order."""
        chosen = chosen[np.argsort(self.keys[chosen], kind="stable")]
        self.keys, self.item, self.place = self.keys[chosen], self.item[chosen], self.place[chosen]

    @property
    def widths(self) -> list[int]:
        """Words per n-gram: n, and the length of each shorter item."""
        return sorted({min(self.n, len(x)) for x in self.items})

    @staticmethod
    def grams(ids: np.ndarray, width: int) -> np.ndarray:
        """Keys of the runs of ``width`` words; runs with a word of no item have key 0."""
        count = len(ids) - width + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        key = np.full(count, np.uint64(width))
        known = np.ones(count, bool)
        for k in range(width):
            part = ids[k : k + count]
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
            known &= part > 0
        return np.where(known, key, np.uint64(0))

    def read(self, text: str | None) -> np.ndarray:
        get = self.numbers.get
        return np.array([get(w, 0) for w in words_of(text)], dtype=np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the document and rows of the n-gram table, for every occurrence."""
        at, rows = [], []
        for width in self.widths:
            keys = self.grams(ids, width)
            where = np.flatnonzero(keys)
            low = np.searchsorted(self.keys, keys[where], "left")
            times = np.searchsorted(self.keys, keys[where], "right") - low
            where, low, times = where[times > 0], low[times > 0], times[times > 0]
            at.append(np.repeat(where, times))
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            rows.append(np.repeat(low, times) + step)
        empty = np.zeros(0, np.int64)
        return (np.concatenate(at), np.concatenate(rows)) if at else (empty, empty)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: its score and the ends (exclusive) in ``item`` and ``words``.

    Word number 0 matches nothing. Each row's run of gaps is a running maximum.
    """
    slope = GAP * np.arange(1, len(words) + 1)
    above = np.zeros(len(words) + 1, np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(item):
        gain = np.where((words == word) & (word > 0), MATCH, MISMATCH)
        row = np.maximum(np.maximum(above[:-1] + gain, above[1:] - GAP), 0)
        row = np.maximum.accumulate(row + slope) - slope
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j + 1)
        above[1:] = row
    return best


def best_copy(item: np.ndarray, ids: np.ndarray, shifts: np.ndarray) -> tuple[float, int, int]:
    """Share of the item's full score, and the word span, of its best copy around the shifts.

    A shift is where the item's first word would fall. Windows leave room for edits on both sides
    and overlapping ones are joined, so a window grows only with the hits in it.
    """
    room = max(8, len(item) // 2)
    best = (0.0, 0, 0)
    shifts = np.unique(shifts)
    cuts = np.flatnonzero(np.diff(shifts) > 2 * room + len(item)) + 1
    for group in np.split(shifts, cuts):
        start = max(0, int(group[0]) - room)
        stop = min(len(ids), int(group[-1]) + len(item) + room)
        score, i, j = align(item, ids[start:stop])
        if score > best[0] * MATCH * len(item):
            _, _, back = align(item[:i][::-1], ids[start : start + j][::-1])
            best = (score / (MATCH * len(item)), start + j - back, start + j)
    return best


def rare(block: Block, frequency: np.ndarray, factor: float = 4.0) -> np.ndarray:
    """Rows of the n-grams that are rare for their item: at most ``factor`` times its median.

    The measure is relative, so at least half of an item's n-grams stay at every corpus size.
    """
    if not len(block.keys):
        return np.zeros(0, np.int64)
    median = pd.Series(frequency).groupby(block.item).transform("median").to_numpy()
    return np.flatnonzero(frequency <= factor * np.maximum(median, 1))


def _blocks(benchmark: DataFrame, n: int, block_bytes: int) -> Iterator[Block]:
    rows = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")
    ).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = -(-total // block_bytes)
    for k in range(count):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield Block.of(sorted((r["item_id"], r["text"]) for r in mine.collect()), n)  # about block_bytes


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 3,
    threshold: float = 0.5,
    long_copy: int = LONG_COPY,
    block_bytes: int = 16 << 20,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, ``item_id``, ``score``, ``start_word``, ``end_word``, ``item_words`` of each copy.

    A document holds a copy of an item (``item_id``, ``text``) when the best local alignment of
    words around a rare shared n-gram reaches ``threshold`` of a full match, or the score of
    ``long_copy`` equal words, which an excerpt of a long item has: 2 for an equal word, -1 for
    another word or a gap. Words are compared with A-Z lower-cased. One row per document
    row and item, for its best copy. Null or empty texts hold nothing; items without words, text
    or id match nothing; items shorter than ``n`` words are one seed; repeated items give equal
    rows; a null document id is carried along. Benchmarks of more than ``block_bytes`` take one
    more pair of passes for each block, which bounds what is sent to the executors.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    context = docs.sparkSession.sparkContext
    out = "doc_id long, item_id long, score double, start_word long, end_word long, item_words long"
    found = docs.sparkSession.createDataFrame([], out)
    for block in _blocks(benchmark, n, block_bytes):
        sent = context.broadcast(block)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pd.DataFrame]:
            block = sent.value
            total = np.zeros(len(block.keys), np.int64)
            for batch in batches:
                for value in batch["text"]:
                    _, rows = block.hits(block.read(value))
                    total[np.unique(rows)] += 1
            row = np.flatnonzero(total)
            yield pd.DataFrame({"row": row, "df": total[row]})

        counts = (
            docs.select("text").mapInPandas(count, "row long, df long").groupBy("row").agg(F.sum("df").alias("df")).toPandas()
        )  # one number per n-gram of the block
        frequency = np.zeros(len(block.keys), np.int64)
        frequency[counts["row"]] = counts["df"]
        block.only(rare(block, frequency))
        seeds = context.broadcast(block)

        def search(batches: Iterator[pd.DataFrame], seeds=seeds) -> Iterator[pd.DataFrame]:
            block = seeds.value
            for batch in batches:
                rows = []
                for name, value in zip(batch["doc_id"], batch["text"]):
                    ids = block.read(value)
                    at, hit = block.hits(ids)
                    if not len(at):
                        continue
                    item = block.item[hit]
                    for k in np.unique(item):
                        mine = item == k
                        score, start, end = best_copy(block.items[k], ids, at[mine] - block.place[hit[mine]])
                        if score >= threshold or round(score * MATCH * len(block.items[k])) >= MATCH * long_copy:
                            rows.append((name, block.item_ids[k], score, start, end, len(block.items[k])))
                frame = pd.DataFrame(rows, columns=[x.split()[0] for x in out.split(", ")])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

        found = found.union(docs.mapInPandas(search, out))
    return found
