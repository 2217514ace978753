"""Exact set-similarity join of word shingles by partitioning the shingle universe.

Two sets whose Jaccard similarity is at least t differ in at most (|x|+|y|)(1-t)/(1+t) elements.
Sets are dealt into bands by size; a band fixes the most elements D in which a linked pair of it
can differ, and hashes the universe into a little more than D+1 segments. Each segment i is worth
a_i in {0, 1, 2}: skipped, indexed whole, or indexed whole and with every single element deleted.
With sum(a_i) = D+1 a linked pair must agree in one segment whose difference is below its worth
(pigeonhole), so every linked pair shares a key. A band orders the steps of worth by cost (keys
written plus pairs met, estimated on a bounded sample) and a set takes as many from the front as
its own size asks for; both sets of a pair take at least those that the smaller one needs. The
order changes the work, never the result.

Going round the segments in a circle, some segment even starts a run in which every prefix differs
by less than its worth (the sum of differences less worths is negative, so start after the
position where its running sum is largest). A key therefore carries the worth of the ``CHAIN``
segments that it starts and a parity sketch of their elements, whose Hamming distance never
exceeds the real difference.

Equal sets collapse to one class first. Inside one key's bucket tasks test sizes, chains and sketches
on arrays, block by block, and write only pairs that pass. A first round writes a spanning forest of
each bucket, so that a group of near copies gives as many rows as it has members; a second one writes
all pairs that are still in different components after the first one's were verified. All pairs
that are written are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import mix64, word_hashes, words_of
from lanewise.llm.components import connected_components
from lanewise.session import discard, stored

BAND_RATIO = 1.5
SKETCH_WORDS = 8
BLOCK = 4096
SHIPPED_WORDS = 32  # of a sketch, beside every key of an open bucket
CHAIN = 4
CHAIN_BITS, WORTH_BITS = 27, 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Link when ``100 * shared >= percent * union``; shingles of ``words`` words."""

    words: int = 3
    percent: int = 90

    def most_different(self, a, b):
        """Largest symmetric difference of a linked pair of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)


def shingle_set(text: str | None, words: int):
    """Sorted distinct 64-bit shingle hashes; fewer words make one shingle, none an empty set."""
    found = words_of(text)
    if not found:
        return np.zeros(0, np.uint64)
    h = word_hashes(found)
    width = min(words, len(h))
    with np.errstate(over="ignore"):
        s = np.full(len(h) - width + 1, np.uint64(width))
        for k in range(width):
            s = mix64(s * _ODD + h[k : len(h) - width + 1 + k])
    return np.unique(s)


def band_of(size: int) -> tuple[int, int]:
    """Number and largest size of the band that holds sets of this size."""
    number, top = 0, 1
    while top < size:
        number, top = number + 1, max(top + 1, int(top * BAND_RATIO))
    return number, top


def band_top(number: int) -> int:
    top = 1
    for _ in range(number):
        top = max(top + 1, int(top * BAND_RATIO))
    return top


def need(size: int, rule: Rule) -> int:
    """D + 1 for a set of this size and partners of up to size / t."""
    return rule.most_different(size, size * 100 // rule.percent) + 1


def segments(number: int, rule: Rule) -> int:
    """Segments of a band: an eighth more than its largest sets need, so that some can be skipped."""
    most = need(band_top(number), rule)
    return most + most // 8


def bands_met(size: int, rule: Rule) -> list[int]:
    """Bands under which a set is filed: its own, and lower ones that hold possible partners."""
    own, _ = band_of(size)
    least = -(-size * rule.percent // 100)
    return [b for b in range(own, -1, -1) if band_top(b) >= least]


def segment_keys(s, number: int, rule: Rule):
    """Key of every segment, its parities, and the deletion keys with the segment of each."""
    m = segments(number, rule)
    with np.errstate(over="ignore"):
        seg = (mix64(s + np.uint64(number + 1)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        seg, parts = seg[order], mix64(s[order] * _ODD)
        run = np.append(np.uint64(0), np.cumsum(parts, dtype=np.uint64))
        edge = np.searchsorted(seg, np.arange(m + 1))
        sums = run[edge[1:]] - run[edge[:-1]]
        salt = mix64(np.arange(m, dtype=np.uint64) + np.uint64(number << 32))
        keys = mix64(sums + salt)
        less = mix64(sums[seg] - parts + salt[seg])
    bits = np.int64(1) << (mix64(s[order] ^ _ODD) % np.uint64(CHAIN_BITS)).astype(np.int64)
    run = np.append(np.int64(0), np.bitwise_xor.accumulate(bits))
    return keys, run[edge[1:]] ^ run[edge[:-1]], less, seg


def cheapest_steps(equal, deleted, steps: int) -> np.ndarray:
    """Segments in the order in which a unit of worth costs least, ``steps`` of them.

    ``equal`` and ``deleted`` are the costs of worth 1 and of worth 2. A second step is taken to
    cost no less than the first, so it comes later.
    """
    equal = np.asarray(equal, float)
    second = np.maximum(np.asarray(deleted, float) - equal, equal)
    step = np.concatenate([equal, second])
    owner = np.tile(np.arange(len(equal)), 2)
    return owner[np.lexsort((np.arange(len(step)), step))[:steps]]


def chains(parity: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Per segment: parities of the run of segments that it starts, and the run's worth below."""
    bits, total = np.zeros_like(parity), np.zeros(len(worth), np.int64)
    for step in range(min(CHAIN, len(worth))):
        bits, total = bits ^ np.roll(parity, -step), total + np.roll(worth, -step)
    return (bits << WORTH_BITS | total).astype(np.uint32).view(np.int32)


def bucket_keys(s, rule: Rule, orders: dict[int, np.ndarray]):
    """All keys under which a set is filed, and the chain that each key starts."""
    keys, runs = [], []
    for number in bands_met(len(s), rule):
        m = segments(number, rule)
        steps = need(min(len(s), band_top(number)), rule)
        worth = np.bincount(orders.get(number, np.arange(m))[:steps], minlength=m)
        whole, parity, less, seg = segment_keys(s, number, rule)
        chain = chains(parity, worth)
        keys += [whole[worth > 0], less[worth[seg] > 1]]
        runs += [chain[worth > 0], chain[seg[worth[seg] > 1]]]
    return np.concatenate(keys).view(np.int64), np.concatenate(runs)


def _sketch(s, rule: Rule) -> np.ndarray:
    """Parities of the set's elements over a power of two of bits that follows its size.

    Unrelated sets differ in about half of the bits, twice what a linked pair may at most.
    """
    words = SKETCH_WORDS
    while 64 * words < 4 * rule.most_different(len(s), len(s)):
        words *= 2
    bit = (mix64(s ^ _ODD) % np.uint64(64 * words)).astype(np.int64)
    parity = np.bincount(bit, minlength=64 * words) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _distance(a: str, b: str) -> str:
    """SQL for the Hamming distance of two sketches; the longer is folded onto the shorter."""
    fold = lambda x, y: f"transform(sequence(0, size({y}) - 1), i -> aggregate(sequence(i, size({x}) - 1, size({y})), 0L, (u, j) -> u ^ {x}[j]))"
    first = f"CASE WHEN size({a}) > size({b}) THEN {fold(a, b)} ELSE {a} END"
    second = f"CASE WHEN size({b}) > size({a}) THEN {fold(b, a)} ELSE {b} END"
    return f"aggregate(zip_with({first}, {second}, (p, q) -> bit_count(p ^ q)), 0, (t, d) -> t + d)"


def _sizes_fit(a: str, b: str, rule: Rule) -> str:
    return f"abs(n{a} - n{b}) <= ((n{a} + n{b}) * {100 - rule.percent}) div {100 + rule.percent}"


def _may_link(a: str, b: str, rule: Rule) -> Column:
    """Whether two sides with columns ``n`` and ``sketch`` can link; the sizes are asked first."""
    most = f"((n{a} + n{b}) * {100 - rule.percent}) div {100 + rule.percent}"
    return F.expr(f"{_sizes_fit(a, b, rule)} AND {_distance('s' + a, 's' + b)} <= {most}")


def _index(docs: DataFrame, rule: Rule, orders: dict[int, np.ndarray]) -> DataFrame:
    """Per document: set size and 128-bit set hash; sketch, keys and chains at the first of equal sets.

    A task files equal sets once, so copies, however many, add at most a row per key and task.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
         ("sketch", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("chains", pa.list_(pa.int32()))]
    )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed = set()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                s = shingle_set(text.as_py(), rule.words)
                with np.errstate(over="ignore"):
                    h1, h2 = mix64(s).sum(dtype=np.uint64), mix64(s * _ODD + np.uint64(1)).sum(dtype=np.uint64)
                row = (doc_id, len(s), int(h1.astype(np.int64)), int(h2.astype(np.int64)))
                if not len(s) or doc_id is None or row[1:] in filed:
                    rows.append((*row, None, None, None))
                    continue
                filed.add(row[1:])
                rows.append((*row, _sketch(s, rule), *bucket_keys(s, rule, orders)))
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        index, "doc_id long, n long, h1 long, h2 long, sketch array<long>, keys array<long>, chains array<int>"
    )


def orders_by_cost(docs: DataFrame, rule: Rule, sample: int = 4000) -> dict[int, np.ndarray]:
    """Order of worth steps per band from about ``sample`` documents (a hash of the id picks them).

    The statistics collected are two numbers per segment and band: at most a third of the longest
    document's words, whatever the number of documents.
    """
    total = docs.count()
    if not total:
        return {}
    rate = min(1.0, sample / total)
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(rate * 1_000_003) + 1)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                s = shingle_set(text, rule.words)
                for number in bands_met(len(s), rule) if len(s) else ():
                    whole, _, less, seg = segment_keys(s, number, rule)
                    yield pd.DataFrame(
                        {
                            "band": number,
                            "seg": np.r_[np.arange(len(whole)), seg],
                            "deleted": np.r_[np.zeros(len(whole), bool), np.ones(len(less), bool)],
                            "key": np.concatenate([whole, less]).view(np.int64),
                        }
                    )

    buckets = (
        picked.select("text").mapInPandas(keys, "band int, seg int, deleted boolean, key long")
        .groupBy("band", "seg", "deleted", "key").agg(F.count("*").alias("c"))
        .groupBy("band", "seg", "deleted")
        .agg(F.sum("c").alias("rows"), F.sum(F.expr("c * (c - 1) / 2")).alias("pairs"))
        .toPandas()
    )
    buckets["cost"] = buckets["rows"] / rate + buckets["pairs"] / rate**2
    orders = {}
    for number, part in buckets.groupby("band"):
        m = segments(int(number), rule)
        cost = np.zeros((2, m))
        cost[part["deleted"].astype(int), part["seg"]] = part["cost"]
        orders[int(number)] = cheapest_steps(cost[0], cost[0] + cost[1], m)
    return orders


def _possible(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Document ids of the pairs of nodes whose sizes and sketches leave a link possible."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link("a", "b", rule))
    return both.select(F.col("ra").alias("a"), F.col("rb").alias("b"))


def _verified(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of document ids whose sets link, compared exactly."""
    pairs = stored(pairs, "pairs")
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pair-ids")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingle_set(t.as_py(), rule.words).tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values, pa.binary())], ["node", "s"])

    held = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(sets, "node long, s binary")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["sa"], batch["sb"]):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= rule.percent * (len(x) + len(y) - shared) and shared > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: held.select(F.col("node").alias(x), F.col("s").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(linked, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, in tables that end where a group ends; a group has two blocks at most."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        if not len(rows):
            continue
        last = np.ones(len(rows), bool)
        for c in ("key", "x", "y"):
            values = rows[c].to_numpy()
            last &= values == values[-1]
        cut = len(rows) - int(last[::-1].argmin() if not last.all() else len(rows))
        if cut:
            yield rows.slice(0, cut).combine_chunks()
        rest = rows.slice(cut).combine_chunks()
    if rest is not None and len(rest):
        yield rest


def _near(rows: pa.Table, rule: Rule, forest: bool) -> np.ndarray:
    """Pairs of nodes of different components that the tests leave, in rows sorted by group.

    Rows are compared with those 1, 2, 3 ... places below them in their group, all groups at once.
    With ``forest`` a pair that is left joins its components within the group, so that a group
    gives fewer pairs than it has rows.
    """
    column = {c: rows[c].to_numpy() for c in ("key", "x", "y", "mine", "node", "component", "n")}
    chain = rows["chain"].to_numpy().view(np.uint32)
    lists = rows["sketch"].combine_chunks()
    words, since = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    length = np.diff(since)
    new = np.ones(len(chain), bool)
    new[1:] = (np.diff(column["key"]) != 0) | (np.diff(column["x"]) != 0) | (np.diff(column["y"]) != 0)
    group, start = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(new))
    label, n, node = column["component"].copy(), column["n"], column["node"]
    inside, mine = column["x"] == column["y"], column["mine"]
    worth, parity = (chain & np.uint32((1 << WORTH_BITS) - 1)).astype(np.int64), chain >> np.uint32(WORTH_BITS)

    def alike(i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        good = np.zeros(len(i), bool)
        for la, lb in set(zip(length[i].tolist(), length[j].tolist())):
            at, short = np.flatnonzero((length[i] == la) & (length[j] == lb)), min(la, lb)
            for part in np.array_split(at, len(at) * max(la, lb) // (1 << 20) + 1):
                sides = [
                    np.bitwise_xor.reduce(words[since[k[part]][:, None] + np.arange(size)].reshape(-1, size // short, short), axis=1)
                    for k, size in ((i, la), (j, lb))
                ]
                good[part] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1) <= most[part]
        return good

    out, i, step = [], np.arange(len(chain)), 0
    while len(i):
        step += 1
        i = i[i + step < len(chain)]
        i = i[group[i] == group[i + step]]
        a, b = i, i + step
        ok = (label[a] != label[b]) & (inside[a] | (mine[a] != mine[b]))
        a, b = a[ok], b[ok]
        most = rule.most_different(n[a], n[b])
        ok = (np.abs(n[a] - n[b]) <= most) & (np.bitwise_count(parity[a] ^ parity[b]) < np.minimum(worth[a], worth[b]))
        a, b, most = a[ok], b[ok], most[ok]
        if not len(a):
            continue
        ok = alike(a, b, most)
        for p, q in zip(a[ok].tolist(), b[ok].tolist()):
            if forest:
                if label[p] == label[q]:
                    continue
                mates = label[start[group[p]] : start[group[p] + 1]]
                mates[mates == label[q]] = label[p]
            out.append((min(node[p], node[q]), max(node[p], node[q])))
    return np.array(out, np.int64).reshape(-1, 2)


def _across(crowded: DataFrame, nodes: DataFrame, labels: DataFrame | None, rule: Rule, forest: bool) -> DataFrame:
    """Possible pairs that share a bucket and lie in different components.

    Buckets are cut into blocks of about ``BLOCK`` members that meet each other once. Tasks compare
    sizes, chains and folded sketches on arrays; only pairs that pass all three become rows.
    """
    known = nodes.select("node", "n", F.col("root").alias("component"))
    if labels is not None:
        known = nodes.join(labels, nodes["root"] == labels["member"], "left").select(
            "node", "n", F.coalesce("component", "root").alias("component")
        )
    told = crowded.join(known, "node")
    open_keys = (
        told.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("c"))
        .where("low < high")
        .select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    )
    folded = F.expr(
        f"CASE WHEN size(sketch) <= {SHIPPED_WORDS} THEN sketch ELSE transform(sequence(0, {SHIPPED_WORDS - 1}), "
        f"i -> aggregate(sequence(i, size(sketch) - 1, {SHIPPED_WORDS}), 0L, (u, j) -> u ^ sketch[j])) END"
    )
    sketches = nodes.groupBy("node").agg(F.first("sketch").alias("sketch")).select("node", folded.alias("sketch"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = (
        told.join(open_keys, "key").join(sketches, "node").withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"),
                "mine", "node", "component", "chain", "n", "sketch")
        .repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "node")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            found = _near(rows, rule, forest)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return _possible(rows.mapInArrow(compare, "a long, b long").distinct(), nodes, rule)


def similar_groups(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text", cost_sample: int = 4000) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row.

    The component is the smallest id reachable over links. Rows without words have no set and
    link with nothing, as do rows without an id, whose component is null. Rows that repeat an id
    are one document with several sets. Other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    index = stored(_index(docs, rule, orders_by_cost(docs, rule, cost_sample)), "shingles")
    sized = index.where("n > 0 AND doc_id IS NOT NULL")
    # the node of a set in the buckets is half of its hash; two sets of one half are both looked at
    nodes = stored(
        sized.groupBy("h1", "h2", "n")
        .agg(F.min("doc_id").alias("root"), F.first("sketch", ignorenulls=True).alias("sketch"))
        .withColumnRenamed("h1", "node"),
        "nodes",
    )
    classes = nodes.select(F.col("node").alias("h1"), "h2", "n", "root")
    members = stored(sized.select("doc_id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).select("doc_id", "root"), "members")

    rows = index.select(F.col("h1").alias("node"), F.inline(F.arrays_zip("keys", "chains"))).toDF("node", "key", "chain")
    rows = rows.repartition("key")
    # sets of one half differ by their chains; both columns also keep the exchange the join's own
    ends = [f(c).alias(name) for c, low, high in (("node", "hub", "top"), ("chain", "least", "most")) for f, name in ((F.min, low), (F.max, high))]
    buckets = rows.groupBy("key").agg(*ends).where("hub < top OR least < most")
    crowded = stored(rows.join(buckets.select("key"), "key").select("key", "node", "chain").distinct(), "crowded")
    sizes = stored(index.select("doc_id", "n"), "sizes")
    discard(index)
    same_id = members.where("doc_id <> root").select(F.col("root").alias("a"), F.col("doc_id").alias("b"))

    links, labels = None, None
    for forest in (True, False):  # a spanning forest of each bucket first, then all that is still open
        more = stored(_verified(_across(crowded, nodes, labels, rule, forest), docs, rule), "links")
        links = more if links is None else links.union(more)
        if forest:
            labels = stored(connected_components(links).toDF("member", "component"), "labels")
    found = connected_components(links.union(same_id)).toDF("member", "component")
    out = sizes.select(F.col("doc_id"), F.col("n").alias("n_shingles"))
    return out.join(found, out["doc_id"] == found["member"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
