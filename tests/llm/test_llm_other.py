"""WARC, secret scan, mixing, surrogates, embeddings, components: against plain Python."""

import hashlib
import io
import math
import random
import re

import numpy as np
import pytest

from lanewise.llm import components, embeddings, mixing, secret_scan, surrogates, warc

# ---- components


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(200, 260)]
    star = [(5, k) for k in range(6, 90)]
    rows = path + star + [(7, 7), (None, 3), (88, 5), (5, 88)]
    got = components.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()
    want = {k: 200 for k in range(200, 261)} | {k: 5 for k in range(5, 90)}
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- WARC


def test_warc_round_trip(spark):
    big = "ä" * 700
    rows = [
        (1, "http://a/1", big, "x"), (4, "http://a/2", big, "x"), (2, None, big, "x"), (3, "u", None, "x"),
        (5, "u\r\nX-Page-ID: 9", "small", "x"), (6, "u", "small", "x"), (None, "u", big, "x"), (4, "again", big, "x"),
        (7, "u", "z" * 3_000_000, "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = warc.read_archives(warc.archive_pages(pages)).collect()
    assert len(got) == len(rows)
    by = {}
    for g in got:
        by.setdefault(g["page_id"], []).append(g)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        for g in by[i]:
            assert (g["payload_bytes"], g["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
            assert g["record_type"] == "revisit" or bytes(g["payload"]) == data
    assert [(g["record_type"], g["refers_to"]) for i in (1, 2, None) for g in by[i]] == [("revisit", 4)] * 3
    assert {g["record_type"] for i in (3, 4, 5, 6, 7) for g in by[i]} == {"response"}
    assert warc.read_archives(warc.archive_pages(pages.limit(0))).count() == 0


def test_warc_members_and_damage():
    record = warc.page_record(1, "u", b"x" * 5000, None)
    data = record + warc.page_record(2, "u", b"", 1)
    for chunk in (1, 7, 1000, 1 << 20):
        found = [warc.read_record(p) for p in warc.read_members(io.BytesIO(data), chunk)]
        assert [r.headers["X-Page-ID"] for r in found] == ["1", "2"]
    with pytest.raises(warc.WarcError):
        list(map(warc.read_record, warc.read_members(io.BytesIO(record[:-9]))))
    bad = warc.encode_record({"WARC-Type": "response", "WARC-Block-Digest": warc.sha1_label(b"other")}, b"block")
    with pytest.raises(warc.WarcError):
        list(map(warc.read_record, warc.read_members(io.BytesIO(bad))))


# ---- secret scan


def slow_spans(text):
    out = []
    patterns = ["(?i:(password|passwd|secret|token|api_?key))" + secret_scan._TAIL, "AKIA[A-Z0-9]+", "[0-9a-f]+"]
    for k, (rule, pattern) in enumerate(zip(secret_scan.BASE_RULES, patterns)):
        for m in re.finditer(pattern, text, re.A):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), k, m.end(), rule.kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secret_scan_equals_plain_search(spark):
    r = random.Random(5)
    bits = ["password", "PassWord", "Tokén", "token", "api_key", "APIKEY", "secret", " = ", ": ", "='", '"', "AKIA", "ABCD1234EFGH5678", "deadbeef", "0123456789abcdef", "short", "é", "\n", "𝄞", "abcdefghijklmnop", " ", "﷐"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(300)]
    texts += [None, "", "token: secret: abcdefghijklmnopq", "x" * 200_000 + " token=" + "a1" * 50_000]
    rows = [(i if i % 50 else None, t, "clash", 1) for i, t in enumerate(texts)] + [(1, texts[1], "clash", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string, row_key int")
    got = secret_scan.report(secret_scan.scan(table)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), slow_spans(t or "")) for i, t, _, _ in rows)
    base = {"assign", "access", "hex"}
    shown = sorted((str(g["doc_id"]), ",".join(s for s in g["spans"].split(",") if s.split(":")[0] in base)) for g in got)
    assert shown == want
    digests = sorted((str(i), hashlib.sha256(slow_spans(t or "").encode()).hexdigest()) for i, t, _, _ in rows)
    assert sorted((str(g["doc_id"]), g["base_sha256"]) for g in got) == digests
    kept = secret_scan.scan(table, keep=True)
    assert {"spans", "row_key"} <= set(kept.columns) and secret_scan.scan(table.limit(0)).count() == 0


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]+") == {frozenset()}
    assert secret_scan.trigram_query("abcd?e") == {frozenset({"abc", "bcd", "cde"}), frozenset({"abc", "bce"})}
    assert secret_scan.trigram_query("(foo|xyz)+bar") == {frozenset({"foo", "bar"}), frozenset({"xyz", "bar"})}
    assert secret_scan.trigram_query("x*") == {frozenset()}


def test_masking(spark):
    table = spark.createDataFrame([(1, "a token=0123456789abcdef0 b"), (2, "clean"), (3, None)], "doc_id long, text string")
    kinds = [r.kind for r in secret_scan.BASE_RULES + secret_scan.MORE_RULES]
    found = secret_scan.scan(table, keep=True)
    got = {r[0]: r[1] for r in found.select("doc_id", secret_scan.masked(found["text"], kinds)).collect()}
    assert got == {1: "a [secret] b", 2: "clean", 3: None}


# ---- mixing


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, budget, out = set(names), share * sum(sizes.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > cap * sizes[s]}
        for s in over or left:
            out[s] = cap * sizes[s] if over else level * weight[s]
            budget -= cap * sizes[s] if over else 0
        left = left - over if over else set()
    return out


def test_mixing_equals_plain_solution(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 30, 200]))), r.choice(["b", "a", "é", None, "c", "tiny"]) if i % 3 else "a", 0) for i in range(900)]
    rows += [(None, "x y", "a", 0), (1, rows[1][1], rows[1][2], 0), (900, None, "none", 0), (901, "  ", "none", 0), (902, "w " * 50_000, "b", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int")
    got = mixing.mix(table).collect()
    again = mixing.mix(table.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = slow_targets(sizes)
    by = {}
    for g in got:
        assert abs(g["target"] - want[g["source"]]) <= 1e-6 * max(1, want[g["source"]]) and g["source_size"] == sizes[g["source"]]
        assert g["taken"] == g["copies"] * g["size"] <= 2 * g["size"]
        by.setdefault(g["source"], []).append(g)
    for s, gs in by.items():
        expected = sum(g["rate"] * g["size"] for g in gs)
        assert abs(expected - want[s]) <= 1e-6 * max(1, want[s])
        assert abs(sum(g["taken"] for g in gs) - want[s]) <= max(0.02 * want[s], 2 if s != "b" else 25_000)
        tilts = {round(math.log(g["rate"] / 1.5) / g["size"], 6) for g in gs if g["size"] > 1 and 1e-6 < g["rate"] < 2}
        assert len(tilts) <= 1 or max(tilts) - min(tilts) < 1e-4  # one lambda per source
    assert mixing.mix(table.limit(0)).count() == 0


# ---- surrogates


def test_surrogates_keep_type_identity_and_text(spark):
    text = "Call +1 (988) 555-2485 or 1 988 555 2485? Card 4539 1488 0343 6467, ip 10.0.0.7, Ann@Example.com; Mr. John Smith met Mrs Smith."
    rows = [(1, text, "x"), (2, text.replace("Smith", "SMITH"), "x"), (3, "no data here", "x"), (4, None, "x"), (None, "bob@example.com", "x"), (5, "", "x"), (1, text, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    got = surrogates.pseudonymise(table, "k").collect()
    assert len(got) == len(rows)
    one = next(g for g in got if g["doc_id"] == 1)
    kinds = [e["kind"] for e in one["entities"]]
    assert kinds == ["phone", "phone", "card", "ip", "email", "given_m", "surname", "surname"][: len(kinds)] or set(kinds) >= {"phone", "card", "ip", "email", "given_m", "surname"}
    names = [e["surrogate"] for e in one["entities"] if e["kind"] == "surname"]
    assert len(set(names)) == 1 and names[0] != "Smith" and "Smith" not in one["text"]
    card = next(e["surrogate"] for e in one["entities"] if e["kind"] == "card")
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", card) and surrogates.luhn(card.replace(" ", "")) and card[0] == "4"
    given = next(e["surrogate"] for e in one["entities"] if e["kind"] == "given_m")
    assert given in surrogates.GIVEN["latin", "m"]
    two = next(g for g in got if g["doc_id"] == 2)
    assert names[0].upper() in two["text"]
    out, at = [], 0
    for e in one["entities"]:
        out += [text[at : e["start"]], e["surrogate"]]
        at = e["end"]
    assert "".join(out) + text[at:] == one["text"]
    rest = {g["doc_id"]: g for g in got}
    assert rest[3]["text"] == "no data here" and rest[4]["text"] is None and rest[5]["text"] == ""
    assert rest[None]["text"] != "bob@example.com" and surrogates.pseudonymise(table.limit(0), "k").count() == 0


def test_surrogates_are_distinct_and_unreal(spark):
    rows = [("ip", f"{a}.{b}.1.1") for a in range(1, 60) for b in range(1, 40)] + [("given_m", n) for n in ("adam", "john", "paul", "bruno", "leo")]
    found = spark.createDataFrame(rows, "kind string, normal string")
    got = surrogates.assign(found, b"key").collect()
    assert len(got) == len(rows) and len({(g["kind"], g["surrogate"]) for g in got}) == len(rows)
    assert not {(g["kind"], g["surrogate"]) for g in got} & set(rows)


def test_hint_covers_every_entity():
    r = random.Random(9)
    bits = ["a@b.co", "1.2.3.4", "4111111111111111", "12-34", "+49 (30) 123-4567", "Frau Weiß", "г-н Петров", "DE44 5001 0517 5407 3249 31", " ", "x", "9", "-", "123-45-6789"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 6)))
        assert not list(surrogates.entities(text)) or re.search(surrogates.HINT, text), text


# ---- embeddings


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(40):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 8)):
            v = base + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.2, 0.35])
            rows.append((len(rows), [float(x) for x in v], int(g % 3) if g % 9 else None))
    hot = [float(x) for x in rng.standard_normal(16)]
    rows += [(1000 + k, hot, 1) for k in range(300)] + [(1400, [-0.0] + hot[1:], 2), (1401, [0.0] + hot[1:], 2)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + hot[1:], 1), (2003, [float("inf")] + hot[1:], 1), (2004, [], 1), (2005, [None] + hot[1:], 1), (2006, hot[:8], 1), (None, hot, 1)]
    table = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, key string")
    got = {g["vec_id"]: g for g in embeddings.near_duplicates(table).collect()}
    ok = {i: (np.array(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: [] for i in got if i is not None}
    for a, (x, la) in ok.items():
        for b, (y, lb) in ok.items():
            if a != b and la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a].append(b)
    found, true = sum(got[i]["n_links"] for i in links), sum(map(len, links.values()))
    assert 0.9 * true <= found <= true and all(got[i]["n_links"] <= len(links[i]) for i in links)
    assert got[1000]["n_links"] >= 299 and got[1001]["component_id"] == 1000 and got[1401]["n_links"] == 1
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(2000, 2006))
    assert got[None]["component_id"] is None and not got[None]["kept"] and len(got) == len(rows)
    assert all(g["kept"] == (g["component_id"] == i) for i, g in got.items() if i is not None)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_tables_reach_the_recall():
    for size in (1, 100, 10_000, 10**9):
        bits, tables = embeddings.plan_tables(size, 0.93, 0.995)
        meet = (1 - math.acos(0.93) / math.pi) ** bits
        assert 1 - (1 - meet) ** tables >= 0.995 or bits == 0
