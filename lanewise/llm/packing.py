"""Packing token sequences: Martello-Toth reduction, then best fit, over the histogram of lengths.

Pieces of one length are interchangeable, so what is packed is a table of at most ``capacity``
lengths with their counts, however many documents there are. The plan says which lengths share a
sequence and how often; each piece then takes its place by its number among the pieces of its
length. Texts and ids never move.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.session import stored

# ---- tokens


class Tokens:
    """Token ids of texts as little-endian 32-bit bytes, from a tokenizer file.

    The tokenizer must be byte-level without prefix space or normaliser. Then no token crosses the
    point before a single space between two characters that are no white space, so a text falls
    into units that are encoded alone, and a unit seen before is looked up. Units are not part of
    the result: ids equal those of the whole text, which the tests check.
    """

    def __init__(self, path: str, most_units: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.bytes_of[number] = len(token)  # byte-level tokens have a character per byte
        self.most_units, self.seen = most_units, {}

    @staticmethod
    def units(text: str) -> list[str]:
        """The text cut before single spaces; all units but the first lack that space."""
        parts = text.split(" ")
        if "" not in parts and list(map(str.strip, parts)) == parts:
            return parts
        out = parts[:1]
        for part in parts[1:]:
            joint = part and out[-1] and not part[0].isspace() and not out[-1][-1].isspace()
            if joint:
                out.append(part)
            else:
                out[-1] += " " + part
        return out

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, units: list[str]) -> None:
        """Encode new units together, and cut the ids where their bytes end."""
        ids = self._ids("".join([" " + u for u in units]))
        ends = np.cumsum(self.bytes_of[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(u.encode()) + 1 for u in units]), side="right")
        data, since = ids.tobytes(), 0
        for unit, cut in zip(units, cuts.tolist()):
            self.seen[unit] = data[4 * since : 4 * cut]
            since = cut

    @staticmethod
    def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
        """The text without the single spaces it is cut before, about every ``size`` characters."""
        since, at = 0, text.find(" ", size)
        while 0 < at < len(text) - 1:
            if text[at - 1].isspace() or text[at + 1].isspace():
                at = text.find(" ", at + 1)
                continue
            yield text[since:at]
            since, at = at + 1, text.find(" ", at + size)
        yield text[since:]

    def encode(self, text: str) -> bytes:
        out = []
        for k, piece in enumerate(self.slices(text)):
            rest = self.units(piece)
            if not k:
                out.append(self._ids(rest[0]).tobytes() if rest[0] else b"")
                rest = rest[1:]
            if len(self.seen) > self.most_units:
                self.seen = {}
            new = list(set(rest).difference(self.seen))
            if new:
                self.learn(new)
            out.extend(map(self.seen.__getitem__, rest))
        return b"".join(out)


@lru_cache(maxsize=1)
def _tokens(path: str) -> Tokens:
    """One per Python worker."""
    return Tokens(path)


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int,
    end_id: int = 0,
    with_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """A row per piece, with ``part`` and ``local``: its number among equal lengths of its task."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, local long"
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    if with_ids:
        names, schema, kinds = [*names, "ids"], f"{schema}, ids binary", [*kinds, pa.binary()]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, numbers = _tokens(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = (tokens.encode(value.as_py()) if value.is_valid else b"") + end
                size = len(ids) // 4
                stops = range((size - 1) % capacity + 1, size + 1, capacity)
                for k, stop in enumerate(stops):
                    start = max(0, stop - capacity)
                    length, mine = stop - start, ids[4 * start : 4 * stop]
                    row = (name, k, start, length, crc32(mine), part, numbers[length])
                    numbers[length] += 1
                    out.append((*row, mine) if with_ids else row)
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


# ---- the plan


@dataclass
class Lengths:
    """How many pieces of each length are left, with the lengths in order."""

    counts: dict[int, int]
    order: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.counts = {w: n for w, n in self.counts.items() if n > 0}
        self.order = sorted(self.counts)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for w, k in Counter(lengths).items():
            self.counts[w] -= k * times
            if not self.counts[w]:
                del self.counts[w]
                self.order.remove(w)

    def left(self, w: int, used: tuple[int, ...]) -> int:
        return self.counts.get(w, 0) - used.count(w)

    def smallest(self, k: int, used: tuple[int, ...], above: int = 0) -> list[int]:
        """The ``k`` smallest lengths over ``above`` beside the used pieces; fewer when there are fewer."""
        out: list[int] = []
        for w in self.order[bisect_right(self.order, above) :]:
            out += [w] * min(k - len(out), self.left(w, used))
            if len(out) == k:
                break
        return out

    def largest(self, most: int, used: tuple[int, ...]) -> int | None:
        """The largest length of at most ``most`` beside the used pieces."""
        for i in range(bisect_right(self.order, most) - 1, -1, -1):
            if self.left(self.order[i], used) > 0:
                return self.order[i]
        return None

    def heaviest_pair(self, most: int, used: tuple[int, ...]) -> int:
        """The largest sum, of at most ``most``, of two pieces beside the used ones; 0 without any."""
        best, low, high = 0, 0, len(self.order) - 1
        while low <= high:
            a, b = self.order[low], self.order[high]
            enough = self.left(a, used) >= (2 if low == high else 1)
            if self.left(b, used) < 1 or a + b > most:
                high -= 1
            else:
                if enough:
                    best = max(best, a + b)
                low += 1
        return best


def dominating(pool: Lengths, w: int, capacity: int) -> tuple[int, ...] | None:
    """A sequence with a piece of length ``w`` that some best packing contains, if that is provable.

    A sequence dominates when whatever else could accompany ``w`` splits into parts that fit, one
    each, where its members are: exchanging them then costs no sequence. With room for one
    companion the longest dominates; with room for two, the longest dominates if no pair is
    longer, and otherwise it and the longest beside it do, unless another pair has both members
    longer than that. Exact complements and pieces that nothing fits with always do.
    """
    room = capacity - w
    a = pool.largest(room, (w,))
    if a is None:
        return (w,)
    if a == room:
        return (w, a)
    least = pool.smallest(3, (w,))
    if len(least) < 2 or least[0] + least[1] > room:
        return (w, a)
    if len(least) == 3 and sum(least) <= room:
        return None  # three or more may accompany it
    if pool.heaviest_pair(room, (w,)) <= a:
        return (w, a)
    b = pool.largest(room - a, (w, a))
    if b is None:
        return None
    longer = pool.smallest(2, (w,), above=b)
    return (w, a, b) if len(longer) < 2 or sum(longer) > room else None


def reduced(pool: Lengths, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences fixed by dominance and how often; they leave the pool.

    Removing pieces keeps what the proof needs, so a sequence is fixed as often as its members last.
    """
    fixed = []
    for w in sorted(pool.counts, reverse=True):
        while w in pool.counts and (found := dominating(pool, w, capacity)):
            need = Counter(found)
            times = min(pool.counts[v] // k for v, k in need.items())
            pool.take(found, times)
            fixed.append((found, times))
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit by falling length: contents as (length, how many) and how many sequences have them.

    A piece goes where the least room stays; sequences with equal contents are one entry. A length
    fills the entry with the least room first, each of its sequences as far as it goes.
    """
    rooms: list[list] = [[] for _ in range(capacity + 1)]  # by room: [contents, times]
    for w in sorted(counts, reverse=True):
        n = counts[w]
        for room in [*range(w, capacity), capacity]:
            if not n:
                break
            entries = rooms[room]
            if room == capacity:
                entries = [((), -(-n // (capacity // w)))]
            rooms[room], each = [], room // w
            for contents, times in entries:
                whole = min(times, n // each)
                part = min(n - whole * each, each - 1) if whole < times else 0
                n -= whole * each + part
                for k, many in ((each, whole), (part, int(part > 0)), (0, times - whole - (part > 0))):
                    if many:
                        rooms[room - k * w].append(((*contents, (w, k)) if k else contents, many))
    return [entry for entries in rooms for entry in entries]


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Places: of each length, runs of its pieces and where they go.

    Rows are (length, first number, pieces a sequence, first sequence, offset), sorted by the first
    two. Piece ``number`` of a run goes to sequence ``first + i // each`` at ``offset + i % each * length``.
    """
    pool = Lengths(dict(histogram))
    entries = [(tuple(Counter(found).items()), times) for found, times in reduced(pool, capacity)]
    entries += best_fit(pool.counts, capacity)
    used: Counter[int] = Counter()
    out, sequence = [], 0
    for contents, times in entries:
        offset = 0
        for w, each in contents:
            out.append((w, used[w], each, sequence, offset))
            used[w] += each * times
            offset += each * w
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


# ---- the operator


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` per piece.

    A document is its token ids and then ``end_id``. One of at most ``capacity`` ids is one piece; a
    longer one is cut from its end into pieces of ``capacity``, so that its first piece may be
    shorter. Pieces fill sequences of at most ``capacity`` ids without gaps. Null and empty texts are
    one piece, the end id; repeated rows are packed each; rows without id too, with a null id;
    empty tables give no rows; other columns are ignored. ``with_ids`` adds ``ids``, little-endian
    32-bit numbers, of which ``sequences`` makes whole sequences.
    """
    cut = stored(pieces(docs, tokenizer, capacity, end_id, with_ids, doc_id, text), "pieces")
    per_task = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    lengths = per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row per length at most
    places = docs.sparkSession.sparkContext.broadcast(plan({r["length"]: r["n"] for r in lengths}, capacity))
    since = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    numbered = cut.join(per_task.select("length", "part", since.alias("since")), ["length", "part"])
    numbered = numbered.withColumn("number", F.col("since") + F.col("local")).drop("since", "local", "part")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = places.value
        first = (rows[:, 0] << 48) + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            number = batch.column("number").to_numpy()
            run = rows[np.searchsorted(first, (length << 48) + number, side="right") - 1]
            i = number - run[:, 1]
            kept = [pa.array(length) if c == "length" else batch.column(c) for c in names]
            sequence, offset = run[:, 3] + i // run[:, 2], run[:, 4] + i % run[:, 2] * length
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``length``, ``ids``: the ids of whole sequences, from pieces that carry theirs."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))  # within one capacity
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias("ids"),
    )
