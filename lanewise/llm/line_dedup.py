"""Repeated lines and paragraphs across documents: one global group per normal form, earliest kept.

Units are lines and paragraphs, or, finer, the sentences of each line. Short units repeat by chance;
they either do not count at all (``min_chars``) or go only within a run of neighbouring repeats that
is long enough as a whole (``min_run_chars``), which is what a copied passage leaves behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def units(text: str | None, min_chars: int) -> Iterator[tuple[int, int, bytes]]:
    """Start, end (code points, with the line break) and normal form of the long enough units.

    A unit is a line, or a paragraph of several lines: a run of lines between blank ones.
    """
    at, lines, since = 0, [], 0
    for line in [*text.split("\n"), ""] if text else ():
        end = min(at + len(line) + 1, len(text))
        normal = b" ".join(line.encode("utf-8", "surrogatepass").lower().split())
        if normal:
            if not lines:
                since = at
            lines.append(normal)
            if _long_enough(normal, min_chars):
                yield at, end, normal
        else:
            if len(lines) > 1:
                whole = b" ".join(lines)
                if _long_enough(whole, min_chars):
                    yield since, min(at, len(text)), whole
            lines = []
        at += len(line) + 1


def _long_enough(normal: bytes, min_chars: int) -> bool:
    """Whether UTF-8 text has at least that many code points, which take one to four bytes each."""
    if len(normal) < min_chars:
        return False
    return len(normal) >= 4 * min_chars or len(normal.decode("utf-8", "surrogatepass")) >= min_chars


SENTENCE_END = re.compile(r"(?<=[.!?])(?=[ \t])|(?<=[。！？।])")


def sentences(text: str | None, min_chars: int) -> Iterator[tuple[int, int, bytes]]:
    """Like ``units``, for the sentences of each line; one starts with its blanks or the line's."""
    at = 0
    for line in text.split("\n") if text else ():
        parts = [p for p in SENTENCE_END.split(line) if p]
        for k, part in enumerate(parts):
            end = at + len(part) + (k == len(parts) - 1)
            normal = b" ".join(part.encode("utf-8", "surrogatepass").lower().split())
            if normal and _long_enough(normal, min_chars):
                yield at, min(end, len(text)), normal
            at += len(part)
        at += 1


def _digests(docs: DataFrame, min_chars: int, cut) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = [
                (doc_id, start, end, place, xxhash.xxh3_128_digest(normal))
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"])
                for place, (start, end, normal) in enumerate(cut(text.as_py(), min_chars))
            ]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "end", "place", "digest"]
            )

    return docs.mapInArrow(digest, "doc_id long, start int, end int, place int, digest binary")


def in_long_runs(spans: list[dict], least: int) -> list[dict]:
    """The spans whose run of neighbouring units holds at least ``least`` characters."""
    out, run = [], []
    for span in [*sorted(spans, key=lambda x: x["place"]), None]:
        if run and (span is None or span["place"] > run[-1]["place"] + 1):
            if sum(s["end"] - s["start"] for s in run) >= least:
                out += run
            run = []
        run.append(span)
    return out


def drop_repeats(
    docs: DataFrame, min_chars: int = 15, doc_id: str = "doc_id", text: str = "text",
    by_sentence: bool = False, min_run_chars: int = 0,
) -> DataFrame:
    """``doc_id``, ``text`` without repeats, ``removed`` and ``kept`` spans of the original text.

    A unit is a line, or a run of lines between blank ones, of at least ``min_chars`` characters,
    compared in lower case (A-Z) with single spaces for spaces and line breaks; shorter ones, which
    repeat by chance, are never removed by themselves. Fifteen characters is the least that eight
    words take. Of equal units the one with the smallest (doc_id, start) stays. Spans are code points with the end exclusive and include
    the line break, and none lies in another, so ``text`` is the concatenation of the kept spans. Null and empty texts stay
    as they are, with no kept span; rows without id are returned unchanged and do not count; rows
    that repeat an id count as one document. Other columns are ignored.

    ``by_sentence`` takes the sentences of each line as units instead. With ``min_run_chars`` a repeat
    goes only within a run of neighbouring repeats of so many characters; it needs ``by_sentence``,
    whose units do not overlap.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if min_run_chars and not by_sentence:
        raise ValueError("min_run_chars needs by_sentence")
    found = _digests(docs.where("doc_id IS NOT NULL"), min_chars, sentences if by_sentence else units)
    first = (
        found.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("times"))
        .where("times > 1")
    )
    repeats = found.join(first, "digest").where(F.struct("doc_id", "start") != F.col("first"))
    per_doc = (
        repeats.select("doc_id", "start", "end", "place").distinct()
        .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "place"))).alias("removed"))
    )
    spans = "array<struct<start:int,end:int>>"
    joined = docs.join(per_doc, "doc_id", "left")

    @F.pandas_udf(f"text string, kept {spans}, removed {spans}")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, removed in batches:
            out = []
            for value, gone in zip(texts, removed):
                if not value:
                    out.append((value, [], []))
                    continue
                if gone is not None and min_run_chars:
                    gone = in_long_runs(gone, min_run_chars)
                kept, cuts, at = [], [], 0
                for span in sorted(gone, key=lambda x: (x["start"], -x["end"])) if gone is not None else ():
                    if span["end"] <= at:  # a line of a removed paragraph
                        continue
                    if span["start"] > at:
                        kept.append({"start": at, "end": span["start"]})
                    cuts.append({"start": span["start"], "end": span["end"]})
                    at = span["end"]
                if at < len(value):
                    kept.append({"start": at, "end": len(value)})
                out.append(("".join(value[k["start"] : k["end"]] for k in kept), kept, cuts))
            yield pd.DataFrame(out, columns=["text", "kept", "removed"])

    done = joined.withColumn("cut", cut("text", "removed"))
    return done.select(
        "doc_id",
        F.col("cut.text").alias("text"),
        F.col("cut.removed").alias("removed"),
        F.col("cut.kept").alias("kept"),
    )
