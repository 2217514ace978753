"""Language ID, n-gram Jaccard join, decontamination, line dedup: against plain Python."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lanewise.llm import decontaminate, jaccard, langid, line_dedup

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, key string, n int, start int"


def words(seed, count, alphabet="abcdefgh"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(2, 6))) for _ in range(count)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "k", 1, 2) for i, t, lang in rows], SCHEMA)


# ---- language ID


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = ["▁", "▁a", "a", "ab", "b", "▁ab"]
    p = np.array([[0.1], [0.2], [0.3], [0.05], [0.25], [0.1]])
    lattice = langid.Lattice(pieces)
    (part, ids), = lattice.by_length(["ab"])
    got = lattice.forward(lattice.arcs(ids, langid._with_none(p)))[0, -1, 0]
    want = 0.1 * 0.3 * 0.25 + 0.2 * 0.25 + 0.1 * 0.05 + 0.1
    assert abs(got - want) < 1e-12


def test_language_id_edges(spark):
    rows = [(i, " ".join(words(i, 40, "aeioust")), "x") for i in range(30)]
    rows += [(100 + i, " ".join(words(i, 40, "bdgkmñ")), "y") for i in range(30)]
    rows += [(200, None, "x"), (201, "", "x"), (202, "12 + 3 ²", None), (None, "aeiou sat", None), (203, "s" * 9000, None)]
    table = docs(spark, rows)
    model = langid.fit(table, langid.read_pieces(PIECES))
    got = {r["doc_id"]: r["lang_id"] for r in langid.predictions(model, table).collect()}
    assert all(got[i]["lang"] == "x" and got[100 + i]["lang"] == "y" for i in range(30))
    assert [got[k]["lang"] for k in (200, 201, 202)] == ["und"] * 3 and got[200]["score"] == 0
    assert got[None]["lang"] == "x" and got[203]["lang"] == "x" and 0 <= got[203]["score"] <= 1
    empty = langid.fit(table.limit(0), ["a"])
    assert {r["lang_id"]["lang"] for r in langid.predictions(empty, table).collect()} == {"und"}
    assert langid.predictions(model, table.limit(0)).count() == 0


def test_language_id_held_out(spark, sf):
    from lanewise.llm.queries import op1_language_id

    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_language_id(spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


# ---- n-gram Jaccard join


def brute_components(rows, width, percent):
    sets = {}
    for i, text, _ in rows:
        if i is None or not text:
            continue
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        if s:
            sets[i] = s
    part = {i: i for i, _, _ in rows if i is not None}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if a < b and 100 * len(x & y) >= percent * len(x | y) and part[a] != part[b]:
                    low, high = sorted((part[a], part[b]))
                    part = {k: low if v == high else v for k, v in part.items()}
    return part


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_equals_brute_force(spark, width, percent):
    rows, r = [], random.Random(width)
    for base in range(12):
        text = words(base, r.choice([3, 8, 25, 60, 150]))
        for copy in range(6):
            edited = list(text)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                edited[r.randrange(len(edited))] = r.choice(["X1", "qq", text[0]])
            rows.append((len(rows) * 7 % 101, " ".join(edited), None))
    rows += [(500, None, None), (501, "", None), (502, " \t\n", None), (None, rows[0][1], None), (503, "Ab", None), (504, "aB", None)]
    got = jaccard.similar_groups(docs(spark, rows), jaccard.Rule(width, percent), cost_sample=30).collect()
    want = brute_components(rows, width, percent)
    assert len(got) == len(rows)
    assert {g["doc_id"]: g["component_id"] for g in got if g["doc_id"] is not None} == want
    sizes = {g["doc_id"]: g["n_shingles"] for g in got}
    assert sizes[500] == sizes[501] == sizes[502] == 0 and sizes[503] == 1
    assert [g["component_id"] for g in got if g["doc_id"] is None] == [None]


def test_jaccard_repeats_and_empty(spark):
    text = " ".join(words(1, 50))
    got = jaccard.similar_groups(docs(spark, [(5, text, None)] * 3 + [(2, text, None)])).collect()
    assert [g["component_id"] for g in got] == [2] * 4
    assert jaccard.similar_groups(docs(spark, []).limit(0)).count() == 0


def test_steps_cover_the_need():
    import numpy as np

    order = jaccard.cheapest_steps([9.0, 1.0, 1.0, 50.0], [10.0, 1.5, 30.0, 60.0], 4)
    assert order.tolist() == [1, 2, 1, 0] and np.bincount(order, minlength=4).max() <= 2


# ---- decontamination


def slow_alignment(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = 2 if a[i - 1] == b[j - 1] and b[j - 1] > 0 else -1
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_plain_recurrence():
    import numpy as np

    r = random.Random(3)
    for _ in range(60):
        a = np.array([r.randint(1, 5) for _ in range(r.randint(1, 12))])
        b = np.array([r.randint(0, 5) for _ in range(r.randint(1, 20))])
        assert decontaminate.align(a, b)[0] == slow_alignment(a.tolist(), b.tolist())


def test_decontamination_finds_edited_copies(spark):
    items = [(k, " ".join(words(900 + k, 30, "abcdefghijklmnop"))) for k in range(6)] + [(6, None), (None, "a b c"), (7, "")]
    edited = items[2][1].split()
    edited[7], edited[15] = "changed", "words"
    del edited[22]
    rows = [
        (1, " ".join(words(1, 300)) + " " + items[1][1].upper() + " " + " ".join(words(2, 300)), None),
        (2, "intro " + " ".join(edited) + " outro", None),
        (3, " ".join(words(5, 500, "abcdefghijklmnop")), None),
        (4, None, None), (5, "", None), (None, items[3][1], None), (None, items[3][1], None),
        (6, " ".join(items[4][1].split()[:9]), None),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs(spark, rows), bench, block_bytes=400).collect()
    found = sorted((g["doc_id"] or -1, g["item_id"]) for g in got)
    assert found == [(-1, 3), (-1, 3), (1, 1), (2, 2)]
    hit = next(g for g in got if g["doc_id"] == 1)
    assert hit["score"] == 1.0 and (hit["start_word"], hit["end_word"]) == (300, 330)
    assert decontaminate.contamination(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contamination(docs(spark, []).limit(0), bench).count() == 0


# ---- line dedup


def test_line_dedup_equals_brute_force(spark):
    shared = " ".join(words(7, 12))
    rows = [
        (3, f"first {shared}\n{shared}\nshort line", None),
        (1, f"{shared.upper()}\nshort line\n  {shared} \nend of it", None),
        (2, f"{shared}", None),
        (4, None, None), (5, "", None), (None, shared, None), (2, shared, None),
        (6, "é " * 9 + "\n" + "é " * 9 + "\n\n", None),
    ]
    got = {}
    for g in line_dedup.drop_repeats(docs(spark, rows)).collect():
        got.setdefault(g["doc_id"], []).append(g)
    assert got[1][0]["text"] == f"{shared.upper()}\nshort line\nend of it"
    assert got[3][0]["text"] == f"first {shared}\nshort line" and [x["text"] for x in got[2]] == ["", ""]
    assert got[4][0]["text"] is None and got[5][0]["text"] == "" and got[None][0]["text"] == shared
    assert got[6][0]["text"] == "é " * 9 + "\n\n"
    source = {i: t for i, t, _ in rows}
    for i, gs in got.items():
        for g in gs:
            if source[i]:
                assert g["text"] == "".join(source[i][k["start"] : k["end"]] for k in g["kept"])
    assert line_dedup.drop_repeats(docs(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("words, percent", [(5, 80), (3, 90), (2, 60)])
def test_linked_sets_share_a_key_whose_chains_meet(words, percent):
    rule, rng, linked = jaccard.Rule(words, percent), np.random.default_rng(percent), 0
    low = (1 << jaccard.WORTH_BITS) - 1
    for trial in range(600):
        n = int(rng.integers(1, 60) if trial % 2 else rng.integers(20, 900))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone, new = rng.integers(0, n // 8 + 2, 2)
        b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 2**63, new).astype(np.uint64)])
        shared = len(np.intersect1d(a, b))
        if not shared or 100 * shared < percent * (len(a) + len(b) - shared):
            continue
        linked += 1
        orders = {}
        for k in set(jaccard.bands_met(len(a), rule) + jaccard.bands_met(len(b), rule)):
            m = jaccard.segments(k, rule)
            orders[k] = jaccard.cheapest_steps(rng.random(m) * 5, rng.random(m) * 9, m)
        filed = {}
        for key, run in zip(*jaccard.bucket_keys(a, rule, orders)):
            filed.setdefault(key, []).append(int(run) & 0xFFFFFFFF)
        assert any(
            ((run ^ int(other) & 0xFFFFFFFF) >> jaccard.WORTH_BITS).bit_count() < min(run & low, int(other) & low)
            for key, other in zip(*jaccard.bucket_keys(b, rule, orders))
            for run in filed.get(key, ())
        )
    assert linked > 100


@pytest.mark.parametrize("copies", [200, 800])
def test_near_misses_give_few_pairs(spark, copies):
    """Copies of one text with two random words changed: most pairs are just below the threshold."""
    r = random.Random(copies)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(copies):
        words = list(base)
        for at in r.sample(range(120), 2):
            words[at] = f"x{r.randrange(10**9)}"
        texts.append(words)
    rule = jaccard.Rule(5, 80)
    sets = [jaccard.shingle_set(" ".join(t), 5) for t in texts]
    rows = {c: [] for c in ("key", "x", "y", "mine", "node", "component", "n", "chain", "sketch")}
    for k, s in enumerate(sets):
        for c, v in (("key", 1), ("x", 0), ("y", 0), ("mine", 0), ("node", k), ("component", k), ("n", len(s)), ("chain", 31), ("sketch", jaccard._sketch(s, rule))):
            rows[c].append(v)
    table = pa.table({c: pa.array(v, pa.list_(pa.int64()) if c == "sketch" else pa.int32() if c == "chain" else pa.int64()) for c, v in rows.items()})
    forest = jaccard._near(table, rule, True)
    assert len(forest) < copies
    most = {(a, b) for a, b in jaccard._near(table, rule, False).tolist()}
    linked = set()
    for a in range(copies):
        for b in range(a + 1, copies):
            shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                linked.add((a, b))
    assert linked <= most and len(most) <= 2 * len(linked) + copies
    assert jaccard._near(table.slice(0, 0), rule, False).shape == (0, 2)
