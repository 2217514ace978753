"""Secret scanning through a trigram index: index, intersect postings, verify.

Each rule's pattern yields a Boolean query over trigrams that every match must contain. The index
holds one posting (trigram, row key) per trigram that some rule asks for. A rule's candidates are
the rows whose postings satisfy its query; only they are searched with the pattern. A pattern that
demands no trigram is searched in every row. All of it is DataFrame expressions; only the queries
are derived on the driver, from the patterns' syntax trees.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

try:
    from re import _constants as _op
    from re import _parser
except ImportError:  # before Python 3.11
    import sre_constants as _op
    import sre_parse as _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.session import stored

MARK, STAND_IN = "﷐", "﷑"  # code points that no text may contain, and of equal length
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_TEXTS = 64
BLOCK = 128
_TAIL = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def any_case(pattern: str) -> str:
    """Every ASCII letter of the pattern in either case, spelled out as classes."""
    return re.sub(r"[A-Za-z]", lambda m: f"[{m[0].upper()}{m[0].lower()}]", pattern)


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


BASE_RULES = [
    Rule("assign", any_case("(password|passwd|secret|token|api_?key)") + _TAIL, 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
]

# Fixed public formats.
MORE_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("source_host", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("payment", r"sk_live_[A-Za-z0-9]+", 24),
]


# ---- the Boolean query of a pattern -------------------------------------------------------------
# A query is a set of alternatives, each a set of trigrams that must all occur; {()} asks nothing.


@dataclass(frozen=True)
class _Part:
    """What is known of a sub-pattern: all its texts if few, and otherwise its query."""

    texts: frozenset[str] | None
    query: frozenset[frozenset[str]]


_ANY = frozenset({frozenset()})


def _and(a, b):
    both = frozenset(x | y for x in a for y in b)
    return _least(both) if len(both) <= 4 * MOST_TEXTS else min(a, b, key=len)


def _least(query):
    """Without alternatives that another one implies."""
    return frozenset(x for x in query if not any(y < x for y in query))


def _of_texts(texts: frozenset[str]):
    return _least(frozenset(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts))


def _class_chars(items) -> frozenset[str] | None:
    found: set[str] = set()
    for op, value in items:
        if op is _op.LITERAL:
            found.add(chr(value))
        elif op is _op.RANGE and value[1] - value[0] < MOST_TEXTS:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    folded = frozenset(c.lower() if c in UPPER else c for c in found)
    return folded if len(folded) <= 3 else None


def _sequence(parts) -> _Part:
    """Join parts; texts are multiplied while they stay few, and closed off into a query else."""
    run: frozenset[str] | None = frozenset({""})
    query, whole = _ANY, True
    for part in parts:
        if part.texts is not None and run is not None and len(run) * len(part.texts) <= MOST_TEXTS:
            run = frozenset(a + b for a in run for b in part.texts)
            continue
        if run is not None:
            query = _and(query, _of_texts(run))
        whole = False
        if part.texts is not None:
            run = part.texts
        else:
            query, run = _and(query, part.query), frozenset({""})
    if whole:
        return _Part(run, _of_texts(run))
    return _Part(None, _and(query, _of_texts(run)))


def _walk(tree) -> _Part:
    parts = []
    for op, value in tree:
        if op is _op.LITERAL:
            c = chr(value)
            parts.append(_Part(frozenset({c.lower() if c in UPPER else c}), _ANY))
        elif op is _op.IN:
            chars = _class_chars(value)
            parts.append(_Part(chars, _ANY))
        elif op is _op.SUBPATTERN:
            parts.append(_walk(value[-1]))
        elif op is _op.BRANCH:
            arms = [_walk(x) for x in value[1]]
            texts = frozenset().union(*(a.texts for a in arms)) if all(a.texts is not None for a in arms) else None
            if texts is not None and len(texts) > MOST_TEXTS:
                texts = None
            parts.append(_Part(texts, _least(frozenset().union(*(a.query for a in arms)))))
        elif op in (_op.MAX_REPEAT, _op.MIN_REPEAT):
            low, high, inner = value
            part = _walk(inner)
            if low == 0:
                texts = part.texts | {""} if high == 1 and part.texts is not None else None
                parts.append(_Part(texts, _ANY))
            elif (low, high) == (1, 1):
                parts.append(part)
            else:
                texts = part.texts if part.texts is not None and low == high else None
                if texts is not None and len(texts) ** low <= MOST_TEXTS:
                    parts.append(_Part(frozenset("".join(x) for x in itertools.product(texts, repeat=low)), _ANY))
                else:
                    parts.append(_Part(None, part.query))
        elif op is _op.AT:
            continue
        else:
            parts.append(_Part(None, _ANY))
    return _sequence(parts)


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """Alternatives of trigrams (A-Z lower-cased), one of which every match contains in full."""
    return _walk(_parser.parse(pattern)).query


# ---- index, candidates, verification ------------------------------------------------------------


def _folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def build_index(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings ``(trigram, row_key)`` of the asked trigrams, one per row and trigram."""
    low = rows.select("row_key", _folded(F.col("text")).alias("low"))
    asked = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)])
    return low.select(F.explode(F.array_compact(asked)).alias("trigram"), "row_key")


def candidates(postings: DataFrame, trigrams: list[str], queries: dict[str, frozenset]) -> DataFrame:
    """Row keys with, per rule, whether their postings satisfy its query."""
    number = {t: i for i, t in enumerate(trigrams)}
    words = range(0, len(trigrams), 62)
    masks = [
        F.bit_or(F.when(F.col("trigram").between(w, w + 61), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("trigram") - w).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"m{w}")
        for w in words
    ]

    def holds(alternative: frozenset[str]) -> Column:
        test = F.lit(True)
        for w in words:
            need = sum(1 << (number[t] - w) for t in alternative if w <= number[t] < w + 62)
            test = test & (F.col(f"m{w}").bitwiseAND(F.lit(need)) == F.lit(need))
        return test

    flags = {}
    for kind, query in queries.items():
        flag = F.lit(False)
        for alternative in sorted(query, key=sorted):
            flag = flag | holds(alternative)
        flags[kind] = flag
    tested = postings.groupBy("row_key").agg(*masks).select("row_key", *[c.alias(f"may_{k}") for k, c in flags.items()])
    return tested.where(" OR ".join(f"may_{k}" for k in flags))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(values: Column) -> Column:
    """An array in arrays of ``BLOCK`` elements, or of its size's square root if that is more."""
    n = F.greatest(F.size(values), F.lit(1))
    size = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(BLOCK))
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda b: F.slice(values, b * size + 1, size))


def _before(values: Column, join) -> Column:
    """What ``join`` makes of 0 and the ints before each element.

    An array grows by copying, so results are appended within blocks only, each of which starts
    from what the blocks before it come to.
    """
    begin = lambda at: F.struct(at.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    add = lambda s, v: F.struct(join(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    def over(blocks: Column, totals: Column) -> Column:
        start = lambda i: F.aggregate(F.slice(totals, F.lit(1), i), F.lit(0), join)
        return F.flatten(F.transform(blocks, lambda b, i: F.aggregate(b, begin(start(i)), add, lambda s: s["out"])))

    total = lambda b: F.aggregate(b, F.lit(0), join)
    return _let(values, lambda v: _let(_blocks(v), lambda blocks: _let(F.transform(blocks, total), lambda totals: over(blocks, totals))))


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, kind, end) of a rule's matches, in code points with the end exclusive.

    The matches are framed with a mark that the text cannot contain; cutting at the marks gives
    text and match in turn, and the lengths before a piece add up to its start.
    """
    java = rule.pattern.replace(r"\x20", " ")
    pieces = F.split(F.regexp_replace(text, F.lit(f"(?:{java})"), F.lit(f"{MARK}$0{MARK}")), MARK)
    step = F.transform(pieces, lambda p, i: F.struct(F.length(p).alias("n"), (i % 2).alias("hit"), (F.length(F.regexp_extract(p, f"^(?:{java})", rule.group)) if rule.group else F.length(p)).alias("size")))

    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,kind:string,end:int>>)").alias("out"))
    kept = lambda s, p: F.when(
        (p["hit"] == 1) & (p["size"] >= rule.least),
        F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), F.lit(rule.kind).alias("kind"), (s["at"] + p["n"]).alias("end")))),
    ).otherwise(s["out"])
    of_block = lambda b: F.aggregate(b, begin, lambda s, p: F.struct((s["at"] + p["n"]).alias("at"), kept(s, p).alias("out")))
    shifted = lambda out, by: F.transform(out, lambda x: F.struct((x["start"] + by).alias("start"), x["kind"].alias("kind"), (x["end"] + by).alias("end")))

    def placed(done: Column) -> Column:
        by = lambda i: F.aggregate(F.slice(done, F.lit(1), i), F.lit(0), lambda a, x: a + x["at"])
        return F.flatten(F.transform(done, lambda x, i: F.when(F.size(x["out"]) > 0, _let(by(i), lambda start: shifted(x["out"], start))).otherwise(x["out"])))

    return _let(step, lambda steps: _let(F.transform(_blocks(steps), of_block), placed))


def scan(
    docs: DataFrame,
    rules: list[Rule] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: bool = False,
) -> DataFrame:
    """``doc_id``, ``text`` and an array ``spans_<kind>`` per rule, one row per input row.

    A null text counts as empty; ids may be null or repeated. Row keys hash id and text: rows that
    share one share their postings, which can only add candidates. Other columns are left out, or
    carried along with ``keep``; then a column named like one of the results is replaced.
    """
    rules = rules or BASE_RULES + MORE_RULES
    queries = {r.kind: q for r in rules if frozenset() not in (q := trigram_query(r.pattern)) and q}
    trigrams = sorted({t for q in queries.values() for a in q for t in a})
    clean = F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, STAND_IN)
    rest = [c for c in docs.columns if keep and c not in (doc_id, text)]
    rows = docs.select(
        F.struct(*rest, F.lit(1).alias("__one")).alias("rest"),
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.xxhash64(doc_id, text).alias("row_key"),
    )
    found = rows
    if trigrams:
        postings = stored(build_index(rows, trigrams), "postings")
        found = rows.join(candidates(postings, trigrams, queries), "row_key", "left")
    none = F.expr("cast(array() as array<struct<start:int,kind:string,end:int>>)")
    out = {}
    for r in rules:
        hit = clean.rlike(r.pattern.replace(r"\x20", " "))
        may = F.coalesce(F.col(f"may_{r.kind}"), F.lit(False)) if r.kind in queries else F.lit(True)
        out[f"spans_{r.kind}"] = F.when(may & hit, spans(clean, r)).otherwise(none)
    carried = [F.col(f"rest.`{c}`").alias(c) for c in rest if c not in out and c not in ("doc_id", "text")]
    return found.select("doc_id", "text", *carried, *[c.alias(k) for k, c in out.items()])


def masked(text: Column, kinds: list[str], sign: str = "[secret]") -> Column:
    """The text with every found span replaced; overlapping spans become one sign. Null stays null.

    A block of spans is cut from its own part of the text, since finding a place in a text reads
    the text up to it.
    """
    ranked = F.array_sort(F.concat(*[F.transform(f"spans_{k}", lambda s: F.struct(s["start"], s["end"])) for k in kinds]))

    def part(block: Column) -> Column:
        """The text from where the block's first span may begin, up to its last end."""
        base = block[0]["at"]
        top = F.aggregate(block, F.lit(0), lambda a, x: F.greatest(a, x["start"]))
        piece = lambda own, x: F.when(x["start"] < x["at"], F.lit("")).otherwise(
            F.concat(F.substring(own, x["at"] - base + 1, x["start"] - x["at"]), F.lit(sign))
        )
        return _let(F.substring(text, base + 1, F.greatest(top - base, F.lit(0))), lambda own: F.array_join(F.transform(block, lambda x: piece(own, x)), ""))

    def cut(found: Column, at: Column) -> Column:
        placed = F.transform(found, lambda x, i: F.struct(x["start"].alias("start"), at[i].alias("at")))
        end = F.aggregate(found, F.lit(0), lambda a, x: F.greatest(a, x["end"]))
        front = F.array_join(_let(placed, lambda p: F.transform(_blocks(p), part)), "")
        return F.concat(front, F.substring(text, end + 1, F.length(text)))

    done = _let(ranked, lambda found: _let(_before(F.transform(found, lambda x: x["end"]), lambda a, e: F.greatest(a, e)), lambda at: cut(found, at)))
    return F.when(F.size(ranked) > 0, done).otherwise(text)


def joined(kinds: list[str]) -> Column:
    """``kind:start:end`` by start and then by the order of ``kinds``, comma-joined."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    every = F.concat(*[f"spans_{k}" for k in kinds])
    ranked = F.array_sort(F.transform(every, lambda s: F.struct(s["start"], order[s["kind"]].alias("rank"), s["end"], s["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(found: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Counts and digest of the base kinds, and all spans, per row."""
    base = [r.kind for r in BASE_RULES]
    kinds = [r.kind for r in (rules or BASE_RULES + MORE_RULES)]
    return found.select(
        "doc_id",
        *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(kinds).alias("spans"),
    )
