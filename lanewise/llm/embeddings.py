"""Near-duplicate vectors: sign hashes of random hyperplanes, exact cosine, components.

Vectors of one label that fall on the same side of ``bits`` hyperplanes share a bucket; several
tables of independent hyperplanes make a missed pair unlikely. Bits grow with the logarithm of
the largest label so that a bucket keeps its expected size, and the tables follow from the bits
and the wanted recall at the threshold, which is the hardest case. Bucket members are compared in
blocks by matrix product; a pair counts in the first table where it meets, so link counts need no
list of pairs, and only edges that join something inside a block are written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.components import connected_components
from lanewise.session import stored

BLOCK = 1024
BUCKET_LOAD = 256


def plan_tables(largest_label: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits per table and number of tables."""
    bits = min(30, math.ceil(math.log2(max(largest_label, 1) / BUCKET_LOAD + 1)))
    meet = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1


def _codes(matrix: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng(seed).standard_normal((matrix.shape[1], tables * bits))
    side = (matrix @ planes > 0).reshape(len(matrix), tables, bits)
    return (side * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def usable() -> Column:
    """Whether a row has an id, a label and a vector that is neither empty, zero nor non-finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    given = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    return F.coalesce(given & ~bad & nonzero, F.lit(False))


def _forest(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Positions of edges that join two parts not joined before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            keep.append(k)
    return np.array(keep, int)


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    recall: float = 0.995,
    seed: int = 7,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row.

    Equal vectors of one label are one class with a size: its members link with each other and
    with every member of a linked class, without being paired. Vectors that are null, empty, zero
    or not finite, and rows without label or id, have no links; a row without id has a null
    component and is kept false. Vectors of different length in one label never link. Rows that
    repeat an id are counted as separate vectors of one component. Of the links at the threshold,
    ``recall`` is the expected share found; closer pairs are found more often.
    """
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(embedding).alias("embedding"),
        F.col(label).cast("string").alias("label"),
    ).withColumn("ok", usable())
    written = F.transform("embedding", lambda x: (x + F.lit(0).cast("float")).cast("string"))  # -0 is 0
    members = rows.where("ok").withColumn("key", F.sha2(F.concat_ws("|", "label", F.concat_ws(",", written)), 256))
    classes = stored(
        members.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("embedding").alias("embedding")),
        "classes",
    )
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(largest, threshold, recall)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = [None] * len(batch)
            lengths = batch["embedding"].str.len().to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                matrix = np.stack(batch["embedding"].iloc[at].to_numpy()).astype(float)
                for k, row in zip(at, _codes(matrix, bits, tables, seed).astype(np.int32)):
                    codes[k] = row
            yield pd.DataFrame({"key": batch["key"], "label": batch["label"], "dims": lengths, "codes": codes})

    coded = stored(classes.select("key", "label", "embedding").mapInPandas(code, "key string, label string, dims int, codes array<int>"), "codes")
    filed = coded.select("key", "label", "dims", F.posexplode("codes").alias("t", "code"))
    buckets = (
        filed.groupBy("label", "dims", "t", "code").agg(F.count("*").alias("c")).where("c > 1")
        .withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    )
    met = filed.join(buckets, ["label", "dims", "t", "code"]).select("key", "t", "blocks")
    rows_ = met.join(coded, "key").join(classes.select("key", "node", "size", "embedding"), "key")
    rows_ = rows_.withColumn("code", F.col("codes")[F.col("t")])
    rows_ = rows_.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows_ = rows_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows_ = rows_.select(
        "label", "dims", "t", "code", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"),
        "mine", "key", "node", "size", "codes", "embedding",
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x, y, t = (int(group[c].iloc[0]) for c in ("x", "y", "t"))
        left = group[group["mine"] == x].sort_values(["node", "key"])
        right = group[group["mine"] == y].sort_values(["node", "key"])
        none = pd.DataFrame({"key": [], "links": [], "a": [], "b": []})
        if not len(left) or not len(right):
            return none
        one, two = (np.stack(s["embedding"].to_numpy()).astype(float) for s in (left, right))
        # scaled by the largest component first, so that squares of tiny or huge values stay finite
        unit = lambda m: (m := m / np.abs(m).max(1, keepdims=True)) / np.sqrt((m * m).sum(1, keepdims=True))
        hit = unit(one) @ unit(two).T >= threshold
        if t:
            a, b = np.stack(left["codes"].to_numpy())[:, :t], np.stack(right["codes"].to_numpy())[:, :t]
            i, j = np.nonzero(hit)
            for at in range(0, len(i), 100_000):
                k = slice(at, at + 100_000)
                hit[i[k], j[k]] = ~(a[i[k]] == b[j[k]]).any(1)
        if x == y:
            hit &= ~np.eye(len(left), dtype=bool)
        size_l, size_r = left["size"].to_numpy(), right["size"].to_numpy()
        links = [pd.DataFrame({"key": left["key"].to_numpy(), "links": hit @ size_r})]
        if x != y:
            links.append(pd.DataFrame({"key": right["key"].to_numpy(), "links": hit.T @ size_l}))
        i, j = np.nonzero(hit)
        a, b = left["node"].to_numpy()[i], right["node"].to_numpy()[j]
        tree = _forest(a, b)
        edges = pd.DataFrame({"a": a[tree], "b": b[tree]})
        links = pd.concat(links)
        return pd.concat([links[links["links"] > 0], edges])

    found = stored(
        rows_.groupBy("label", "dims", "t", "code", "x", "y").applyInPandas(compare, "key string, links long, a long, b long"),
        "found",
    )
    links = found.where("key IS NOT NULL").groupBy("key").agg(F.sum("links").alias("links"))
    per_class = classes.select("key", "node", "size").join(links, "key", "left")
    same = members.select("vec_id", "key").join(per_class, "key").select(
        F.col("vec_id").alias("id"), "key", "node", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n")
    )
    same = stored(same, "members")
    edges = found.where("a IS NOT NULL").select("a", "b").union(same.where("id <> node").select("node", "id"))
    component = connected_components(edges).toDF("id", "component")
    every = same.select("id", "n").union(rows.where("NOT ok").select("vec_id", F.lit(0).cast("long")))
    return every.join(component, "id", "left").select(
        F.col("id").alias("vec_id"),
        F.col("n").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )
