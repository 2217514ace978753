"""Sentence units and runs of repeats, against a brute-force search over all units."""

import random
import re

from lanewise.llm import line_dedup


def brute(docs, least):
    """Removed spans per document: repeated sentences in runs of enough characters."""
    units, seen = {}, set()
    for name, text in sorted(docs.items()):
        at, mine = 0, []
        for line in (text or "").split("\n"):
            parts = [p for p in re.split(r"(?<=[.!?])(?=[ \t])|(?<=[。！？।])", line) if p]
            for k, part in enumerate(parts):
                end = min(at + len(part) + (k == len(parts) - 1), len(text))
                normal = " ".join(part.split()).lower()
                if normal:
                    mine.append((at, end, normal in seen))
                    seen.add(normal)
                at += len(part)
            at += 1
        units[name] = mine
    out = {}
    for name, mine in units.items():
        gone, run = [], []
        for unit in [*mine, (0, 0, False)]:
            if unit[2]:
                run.append(unit[:2])
                continue
            gone += run if sum(b - a for a, b in run) >= least else []
            run = []
        out[name] = gone
    return out


def test_runs_of_sentences_equal_brute_force(spark):
    r = random.Random(9)
    pool = [f"{r.choice(['The', 'A', 'No'])} {'lane ' * r.randint(0, 6)}{k % 40}{r.choice('.!?')}" for k in range(60)]
    pool += ["短い文。", "これは長い文である。", "Stock line.", "", "  "]
    docs = {i: "".join(r.choice(pool) + r.choice([" ", "\n", "\n\n"]) for _ in range(r.randint(0, 25))) for i in range(150)}
    docs |= {150: None, 151: "", 152: docs[3], 153: "Unique start. " + docs[4] + "\nUnique end"}
    table = spark.createDataFrame([(i, t, "x") for i, t in docs.items()] + [(None, docs[3], "x")], "doc_id long, text string, removed string")
    for least in (0, 30, 90):
        got = line_dedup.drop_repeats(table.repartition(4), 1, by_sentence=True, min_run_chars=least).collect()
        want = brute(docs, least)
        assert len(got) == len(docs) + 1
        for g in got:
            if g["doc_id"] is None:
                assert g["text"] == docs[3]
                continue
            text, spans = docs[g["doc_id"]], want[g["doc_id"]]
            assert [(s["start"], s["end"]) for s in g["removed"] or []] == (spans if text else [])
            kept = [k for k in range(len(text or "")) if not any(a <= k < b for a, b in spans)]
            assert g["text"] == (text if not text else "".join(text[k] for k in kept))
