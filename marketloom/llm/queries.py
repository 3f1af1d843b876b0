"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import chat, dedup, html, licenses, merkle, ngram_join, packing, pieces, repair, secrets, topk, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@query
def op1_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(read(spark, folder, "pages"))


@query
def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its component under 3-word shingles and a similarity of 0.9."""
    return ngram_join.near_duplicates(read(spark, folder, "documents"), width=3, percent=90)


@query
def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and one full of control strings, formatted and read back."""
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.digests(chat.conversations_of(chat.chat_windows(rows.unionByName(odd))))


ORACLES["op3_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (
  SELECT *, row_number() OVER o AS k, len(regexp_extract_all(text, '[^ 	-
]+')) + 3 AS tokens,
         length(role) + length(text) + 14 + length(regexp_replace(role || text, '[^\\#<:]', '', 'g')) AS chars
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
u AS (
  SELECT *, k = 1 AND role = 'system' AS system, max(CASE WHEN k = 1 AND role = 'system' THEN tokens ELSE 0 END) OVER p AS opening,
         max(CASE WHEN k = 1 AND role = 'system' THEN chars ELSE 0 END) OVER p AS opening_chars
  FROM t WINDOW p AS (PARTITION BY conv_id)),
v AS (
  SELECT *, greatest(416 - opening, 128) AS room, CASE WHEN system THEN 0 ELSE tokens END AS counted,
         (sum(CASE WHEN system THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY k))::BIGINT - CASE WHEN system THEN 0 ELSE tokens END AS start
  FROM u),
w AS (SELECT *, start * 2 // room AS stretch, counted * 2 > room AS long FROM v),
x AS (
  SELECT *, k > 1 AND NOT lag(system) OVER o AND (stretch <> lag(stretch) OVER o OR long OR lag(long) OVER o) AS later,
         coalesce(sum(CASE WHEN system THEN 0 ELSE chars END) OVER (PARTITION BY conv_id ORDER BY start RANGE BETWEEN 96 PRECEDING AND 1 PRECEDING), 0) AS past
  FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY k)),
y AS (
  SELECT conv_id, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS told,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '') AS loss, count(*) AS n_turns,
         sum(chars + CASE WHEN later THEN past + opening_chars ELSE 0 END)::BIGINT AS formatted_chars
  FROM x GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM y"""


@query
def op4_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five best rows for every embedding whose id is divisible by 50."""
    return topk.top_k(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op4_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its toxicity score."""
    return toxicity.classified(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    return packing.pack(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    return dedup.exact_duplicates(read(spark, folder, "documents"))


ORACLES["op7_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n"""


@query
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the licence notices in it."""
    return licenses.scan(read(spark, folder, "documents"))


ORACLES["op8_license_scan"] = licenses.oracle()


@query
def op9_warc_assembly(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to an archive and read back as a capture."""
    return warc.round_trip(read(spark, folder, "pages"))


ORACLES["op9_warc_assembly"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT *, sha1(t) AS s, max(page_id) OVER (PARTITION BY t) AS leader FROM p),
d AS (
  SELECT *, [(instr('0123456789abcdef', substr(s, 5 * k + 1, 1)) - 1) * 65536 + (instr('0123456789abcdef', substr(s, 5 * k + 2, 1)) - 1) * 4096
             + (instr('0123456789abcdef', substr(s, 5 * k + 3, 1)) - 1) * 256 + (instr('0123456789abcdef', substr(s, 5 * k + 4, 1)) - 1) * 16
             + instr('0123456789abcdef', substr(s, 5 * k + 5, 1)) - 1 FOR k IN range(8)] AS v FROM h)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1) FOR i IN range(32)], '')
         AS payload_digest,
       CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> leader THEN leader END AS refers_to, true AS has_request, true AS has_metadata
FROM d"""


@query
def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded."""
    return pieces.round_trip(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its leaf, roots and witness, checked with a fifth of the texts altered."""
    return merkle.tamper_check(read(spark, folder, "documents"))


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation after damage, with its cheapest repair."""
    return repair.damage_check(read(spark, folder, "conversations"))


@query
def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the secrets in it."""
    return secrets.scan(read(spark, folder, "documents"))


ORACLES["op13_secret_scan"] = secrets.oracle()


#: CRC-32 of a decimal string, unsigned.
CRC32 = (
    "xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split({}, '')], "
    "lambda a, b: list_reduce([xor(a, b)] || range(8), lambda u, i: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295)"
)
_ENCODED = " || ".join(f"CASE WHEN {{}}{c} IS NULL THEN '-' ELSE strlen({{}}{c}::VARCHAR) || ':' || {{}}{c} END" for c in ("doc_id", "source", "lang", "n_chars"))
_ENCODED = _ENCODED.replace("{}", "") + " || CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}) || ':' || {0} END"
_RUN = "coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos {} a.pos), '')"
ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_ENCODED.format("text")}) AS leaf,
         CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 5 = 0
              THEN sha256({_ENCODED.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS presented
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
up AS (
  SELECT source, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS size FROM l
  UNION ALL
  SELECT source, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((size + 15) // 16)
  FROM up WHERE size > 1 GROUP BY source, level, pos // 16),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM up WHERE size = 1),
top AS (
  SELECT 0 AS level, pos, subroot AS digest, count(*) OVER () AS size FROM s
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), any_value((size + 15) // 16)
  FROM top WHERE size > 1 GROUP BY level, pos // 16),
near AS (
  SELECT a.source, a.level, a.pos, {_RUN.format("<")} AS l, {_RUN.format(">")} AS r
  FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.pos // 16 = b.pos // 16
  WHERE a.size > 1 GROUP BY ALL),
far AS (
  SELECT a.level, a.pos, {_RUN.format("<")} AS l, {_RUN.format(">")} AS r
  FROM top a JOIN top b ON a.level = b.level AND a.pos // 16 = b.pos // 16 WHERE a.size > 1 GROUP BY ALL),
f AS (
  SELECT source, pos AS leaf_pos, 0 AS level, pos, coalesce(presented, leaf) AS digest, '' AS proof FROM l
  UNION ALL
  SELECT f.source, leaf_pos, f.level + 1, f.pos // 16, sha256(n.l || digest || n.r), proof || n.l || n.r
  FROM f JOIN near n ON n.source IS NOT DISTINCT FROM f.source AND n.level = f.level AND n.pos = f.pos),
h AS (SELECT source, leaf_pos, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM f GROUP BY ALL),
g AS (
  SELECT h.source, leaf_pos, 0 AS level, s.pos, digest, proof FROM h JOIN s ON s.source IS NOT DISTINCT FROM h.source
  UNION ALL
  SELECT g.source, leaf_pos, g.level + 1, g.pos // 16, sha256(n.l || digest || n.r), proof || n.l || n.r
  FROM g JOIN far n ON n.level = g.level AND n.pos = g.pos),
e AS (SELECT source, leaf_pos, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM g GROUP BY ALL)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(e.proof) AS proof_sha256, e.digest AS folded_root, e.digest = t.digest AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN e ON e.source IS NOT DISTINCT FROM l.source AND e.leaf_pos = l.pos
CROSS JOIN (SELECT digest FROM top WHERE size = 1) t"""


def _option(allowed: str, cost: str, letter: str, line: str, rest: str) -> str:
    """One edit and what follows it, as a value that sorts by cost and then by audit."""
    return f"CASE WHEN {allowed} THEN {{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 't': {line} || {rest}.t}} ELSE {{'c': 1e9::BIGINT, 'a': '', 't': ''}} END"


def _state(state: str, wanted: str, after: str, keeps_system: bool) -> str:
    line = "chr(10) || {} || ':' || text"
    options = [
        _option("true", "3", "D", "''", f"w.{state}"),
        _option("stays", "2 + cut", "R", line.format(f"'{wanted}'"), f"w.{after}"),
        _option(f"stays AND initial = '{wanted[0]}'", "cut", "K", line.format("role"), f"w.{after}"),
    ]
    if keeps_system:
        options.append(_option("stays AND initial = 's'", "cut", "K", line.format("role"), "w.s"))
    return f"list_min([{', '.join(options)}])"


def _inserted(state: str, wanted: str, after: str) -> str:
    return f"list_min([{state}, {{'c': {after}.c + 2, 'a': 'I' || {after}.a, 't': chr(10) || '{wanted}:' || {after}.t}}])"


ORACLES["op12_conversation_repair"] = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE kind > 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS place FROM d),
m AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again, role[1] AS initial,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) || role[1] AS pair,
         count(*) OVER (PARTITION BY conv_id) - place AS left_over, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS ending
  FROM o),
r AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'ok' END AS fault,
         fault IN ('ok', 'truncated') AS stays, (fault = 'truncated')::INT AS cut FROM m),
v AS (
  SELECT conv_id, -1::BIGINT AS done, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS q, {{'c': 4::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s,
         {{'c': 2::BIGINT, 'a': 'I', 't': chr(10) || 'assistant:'}} AS u, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS a
  FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT conv_id, done, {_inserted("q0", "user", "u1")}, {_inserted("s0", "user", "u1")}, u1, a1
  FROM (SELECT *, {_inserted("u0", "assistant", "a0")} AS u1, {_inserted("a0", "user", "u0")} AS a1
        FROM (SELECT w.conv_id, r.left_over AS done, {_state("q", "user", "u", True)} AS q0, {_state("s", "user", "u", False)} AS s0,
                     {_state("u", "assistant", "a", False)} AS u0, {_state("a", "user", "u", False)} AS a0
              FROM v w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.left_over = w.done + 1))),
b AS (SELECT conv_id, arg_max(q, done) AS q FROM v GROUP BY conv_id),
n AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (place > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, q.c AS cost, q.a AS audit, sha256(q.t[2:]) AS repaired_sha256
FROM b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id"""
