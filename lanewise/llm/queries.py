"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import (
    conversations,
    decontaminate,
    embeddings,
    importance,
    jaccard,
    katz,
    langid,
    line_dedup,
    mixing,
    packing,
    secret_scan,
    surrogates,
    warc,
)
from lanewise.llm.common import crc_bucket, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def query(build, oracle: str | None = None):
    QUERIES[build.__name__] = build
    if oracle is not None:
        ORACLES[build.__name__] = oracle.strip()
    return build


def _query(oracle: str | None = None):
    return lambda build: query(build, oracle)


ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = f"list_filter(regexp_split_to_array({ASCII_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@_query()
def op1_language_id(spark: SparkSession, sf_dir: str, pieces: str = PIECES) -> DataFrame:
    """Language of every document, learned from the documents whose id's crc32 is no multiple of 5."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_bucket("doc_id", 5) != 0), langid.read_pieces(pieces))
    found = langid.predictions(model, docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        (crc_bucket("doc_id", 5) == 0).alias("held_out"),
        F.col("lang_id.lang").alias("lang_pred"),
        F.col("lang_id.score").alias("score"),
    )


@_query(f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY 1) m ON m.a = d.doc_id
""")
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingle sets reach a Jaccard similarity of 0.9."""
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), jaccard.Rule(3, 90))


@_query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
t AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS target FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN target <> page_id THEN target END AS refers_to
FROM t
""")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    manifest = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def _secrets_sql() -> str:
    mark = "chr(64976)"
    parts, kinds = [], secret_scan.BASE_RULES + secret_scan.MORE_RULES
    for i, r in enumerate(kinds):
        pattern = r.pattern.replace("'", "''")
        size = f"length(regexp_extract(p, '^(?:{pattern})', {r.group}))" if r.group else "length(p)"
        parts.append(
            f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, since AS s, since + length(p) AS e FROM ("
            f"SELECT doc_id, i, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p) AS since FROM ("
            f"SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM ("
            f"SELECT doc_id, string_split(regexp_replace(text, '({pattern})', {mark} || '\\1' || {mark}, 'g'), {mark}) AS ps FROM d)))"
            f" WHERE i % 2 = 0 AND {size} >= {r.least}"
        )
    spans = "coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) {0}, '')"
    base = "FILTER (k < 3)"
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {mark}, chr(64977)) AS text FROM documents),
f AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256({spans.format(base)}) AS base_sha256, {spans.format("")} AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


@_query(_secrets_sql())
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


@_query("""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY 1),
c AS (SELECT a, count(*) AS c FROM l GROUP BY 1)
SELECT vec_id, coalesce(c, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN c ON c.a = vec_id
""")
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of embeddings of one label with a cosine of 0.93 or more."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@_query()
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of benchmark items in the documents."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query()
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 150 characters or more that an earlier text has, by sentences."""
    return line_dedup.drop_repeats(table(spark, sf_dir, "documents"), min_chars=1, by_sentence=True, min_run_chars=150)


@_query()
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 3 : 1 : 2 over the sources, half as many words again as there are."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "rate"
    )


@_query()
def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    return surrogates.pseudonymise(table(spark, sf_dir, "documents"), key="lanewise")


@_query()
def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a trigram model of the documents whose id's crc32 is no multiple of 10."""
    return katz.score_documents(table(spark, sf_dir, "documents"), crc_bucket("doc_id", 10) == 0, order=3)


def _crc32_sql(hex_bytes: str, seed: str = "0") -> str:
    """crc32 of bytes in hexadecimal, seeded with the crc32 of what comes before them."""
    half = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    step = f"list_reduce(range(8), lambda c, i: {half}, xor(a, b))"
    numbers = f"list_transform(range(0, len({hex_bytes}) // 2), lambda i: ('0x' || {hex_bytes}[2 * i + 1:2 * i + 2])::BIGINT)"
    return f"xor(list_reduce({numbers}, lambda a, b: {step}, xor(({seed})::BIGINT, 4294967295)), 4294967295)"


def _state_sql(rows: str, state: str, moves: list[tuple[str, str, int, str, str]]) -> str:
    """The least (cost, edits, text) that leads to a state: from, condition, cost, edits, role."""
    ways = [
        f"CASE WHEN {condition} THEN {{'cost': r.{source}.cost + {cost}, 'audit': r.{source}.audit || '{edits}', 'said': r.{source}.said || {said}}} END"
        for source, condition, cost, edits, said in moves
    ]
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x.cost IS NOT NULL)) AS {state}"


def _repair_sql() -> str:
    nothing, done = "[]::VARCHAR[]", "{'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]}"
    never = "NULL::STRUCT(cost BIGINT, audit VARCHAR, said VARCHAR[])"
    may, keep = "NOT d.bad", "[d.role || ':' || d.text]"
    turn = {"e": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    ways: dict[str, list] = {state: [(state, "true", 3, "D", nothing)] for state in turn}
    for state in turn:
        first, second = turn[state], turn[turn[state]]
        added = f"['{name[first]}:']"
        for before, cost, edit, start in ((nothing, "d.cut", "", state), (added, "2 + d.cut", "I", first)):
            there = turn[start]
            ways[there].append((state, f"{may} AND d.i = '{there}'", cost, f"{edit}K", f"list_concat({before}, {keep})"))
            ways[there].append((state, may, f"2 + {cost}", f"{edit}R", f"list_concat({before}, ['{name[there]}:' || d.text])"))
    ways["s"].append(("e", f"{may} AND d.i = 's'", "d.cut", "K", keep))
    steps = ",\n  ".join(_state_sql("d", state, moves) for state, moves in ways.items())
    finish = {"e": (0, "", nothing), "s": (4, "II", "['user:', 'assistant:']"), "u": (2, "I", "['assistant:']"), "a": (0, "", nothing)}
    ends = ", ".join(
        f"CASE WHEN {s}.cost IS NOT NULL THEN {{'cost': {s}.cost + {c}, 'audit': {s}.audit || '{e}', 'said': list_concat({s}.said, {w})}} END"
        for s, (c, e, w) in finish.items()
    )
    blank = "regexp_full_match(text, '[\\x20\\x09-\\x0D]*')"
    crc = _crc32_sql("hex(encode(k))")
    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
f AS (SELECT *, {crc} % 20 AS fault FROM k),
m AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE fault <> 0),
o AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS i, {blank} AS blank,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen FROM o),
d AS (
  SELECT conv_id, turn, role, text, i, n, blank, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND cut AS truncated,
    blank OR seen AS bad, (NOT blank AND NOT seen AND cut)::BIGINT AS cut,
    n > 1 AND lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i NOT IN ('su', 'ua', 'au') AS illegal FROM p),
r AS (
  SELECT conv_id, 0::BIGINT AS n, {done} AS e, {never} AS s, {never} AS u, {never} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT r.conv_id, d.n, {steps}
  FROM r JOIN d ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND d.n = r.n + 1),
z AS (SELECT conv_id, list_min(list_filter([{ends}], lambda x: x.cost IS NOT NULL)) AS best FROM r
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
t AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM d GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit,
  sha256(array_to_string(best.said, chr(10))) AS repaired_sha256
FROM z LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM z.conv_id"""


@_query(_repair_sql())
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and the cheapest edits that mend each."""
    rows = table(spark, sf_dir, "conversations")
    found = conversations.repair_report(conversations.damaged(rows), rows)
    return found.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


FEATURE_WORDS_SQL = f"list_filter(regexp_split_to_array({ASCII_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


@_query(f"""
WITH w AS (SELECT 'd' AS side, doc_id, row_number() OVER () AS r, coalesce({FEATURE_WORDS_SQL}, []) AS ws FROM documents
  UNION ALL SELECT 'b', NULL, -row_number() OVER (), coalesce({FEATURE_WORDS_SQL}, []) FROM benchmark),
f AS (SELECT side, r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM w),
h AS (SELECT g, {_crc32_sql("hex(encode(g))")} % 10000 AS bucket FROM (SELECT DISTINCT g FROM f)),
b AS (SELECT side, r, bucket FROM f JOIN h USING (g)),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM b GROUP BY 1),
c AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n),
k AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM n, c),
m AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS total FROM b JOIN k USING (bucket) WHERE side = 'd' GROUP BY r),
x AS (SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
    ('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM w LEFT JOIN m USING (r) WHERE side = 'd'),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
    count(*) FILTER (n_words >= 20) OVER () * 25 // 100 AS drawn FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM z
""")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn by their likeness to the benchmark."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


@_query()
def op13_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path)
