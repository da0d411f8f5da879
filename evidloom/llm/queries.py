"""Registered queries of the training-data operators and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.chat import format_preferences, preference_turns
from evidloom.llm.common import crc_mod, documents, ready, table
from evidloom.llm.conversation_repair import damaged_turns, repair_report
from evidloom.llm.decontaminate import find_leaks
from evidloom.llm.importance import importance_resample
from evidloom.llm.line_dedup import drop_repeated_lines
from evidloom.llm.mixture_pack import mixture_pack
from evidloom.llm.near_dup import near_duplicates
from evidloom.llm.quality_rank import fit_ranking, score_quality
from evidloom.llm.quality_rules import quality_rules
from evidloom.llm.simhash_dedup import simhash_duplicates
from evidloom.llm.token_counts import count_tokens
from evidloom.llm.token_output import pack_matrix
from evidloom.llm.toxicity import fit_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP8_SQL = f"""
WITH l AS (
  SELECT doc_id, pos, line, {LOWER_SQL.format(f"trim(line, {SPACE_SQL})")} AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)),
f AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT l.doc_id, l.pos, l.line, f.k IS NOT NULL AND f.keeper <> l.doc_id AS gone
  FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op8_line_dedup", OP8_SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op5_mixture_pack")
def op5_mixture_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return mixture_pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op1_near_dup")
def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "n_windows", "start", "similarity")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


@query("op7_quality_rank")
def op7_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_ranking(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score_quality(docs, model).select(
        "doc_id", (crc_mod(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules(docs, table(spark, sf_dir, "labels").where("quality = 1"))


@query("op3_token_matrix")
def op3_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_matrix(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                       public_tokenizers.path("byte_bpe_50k.tiktoken"), end_id=50256, pad_id=50256)


OP4_SQL = """
WITH last AS (
  SELECT conv_id, max_by(text, (turn, text)) AS answer, max(turn) AS turn
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
t AS (
  SELECT c.conv_id, c.turn, coalesce(c.role, '') AS role, coalesce(c.text, '') AS chosen,
         CASE WHEN c.turn = l.turn AND c.role = 'assistant' THEN coalesce(o.answer, '')
              ELSE coalesce(c.text, '') END AS rejected
  FROM conversations c LEFT JOIN last l ON l.conv_id = c.conv_id
  LEFT JOIN last o ON o.conv_id = xor(c.conv_id, 1)),
d AS (SELECT conv_id, min(turn) FILTER (chosen <> rejected) AS first FROM t GROUP BY conv_id),
r AS (
  SELECT t.conv_id, t.turn, t.role, d.first IS NULL OR t.turn < d.first AS shared,
         '<|im_start|>' || t.role || chr(10) || chosen || '<|im_end|>' || chr(10) AS c,
         '<|im_start|>' || t.role || chr(10) || rejected || '<|im_end|>' || chr(10) AS j
  FROM t JOIN d ON d.conv_id = t.conv_id),
p AS (
  SELECT *, sum(length(c)) OVER w AS c_end, sum(length(j)) OVER w AS j_end, length(role) + 13 AS head
  FROM r WINDOW w AS (PARTITION BY conv_id, shared ORDER BY turn))
SELECT conv_id AS pair_id, count(*) FILTER (shared) AS n_prompt_turns,
       coalesce(string_agg(c, '' ORDER BY turn) FILTER (shared), '') AS prompt,
       coalesce(string_agg(c, '' ORDER BY turn) FILTER (NOT shared), '') AS chosen,
       coalesce(string_agg(j, '' ORDER BY turn) FILTER (NOT shared), '') AS rejected,
       coalesce(string_agg((c_end - length(c) + head)::VARCHAR || '-' || c_end::VARCHAR, ',' ORDER BY turn)
                FILTER (NOT shared AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((j_end - length(j) + head)::VARCHAR || '-' || j_end::VARCHAR, ',' ORDER BY turn)
                FILTER (NOT shared AND role = 'assistant'), '') AS rejected_mask
FROM p GROUP BY conv_id
"""


@query("op4_preference_format", OP4_SQL)
def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(preference_turns(table(spark, sf_dir, "conversations")))


@query("op11_simhash_dedup")
def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


# CRC-32 of the UTF-8 bytes of ``w`` in a relation: the 256 steps by rule, then a fold over the bytes
CRC_STEPS_SQL = """SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1
           THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS steps"""
CRC_SQL = """xor(4294967295::BIGINT, list_reduce(
         list_transform(range(length(hex({0})) // 2), lambda i: ('0x' || substr(hex({0}), 2 * i + 1, 2))::BIGINT),
         lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1]), 4294967295::BIGINT))"""

OP12_SQL = f"""
WITH st AS ({CRC_STEPS_SQL}),
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")},
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
bw AS (SELECT unnest(regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")},
              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
dw AS (SELECT r, unnest(ws) AS w FROM w),
v AS (SELECT w, {CRC_SQL.format("w")} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), st),
s AS (SELECT b, count(*) AS n FROM dw JOIN v USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN v USING (w) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE
              / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM s FULL JOIN t USING (b)),
m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN v USING (w) JOIN g USING (b) GROUP BY r),
x AS (SELECT w.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT
               + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM w LEFT JOIN m USING (r)),
k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS p FROM x)
SELECT doc_id, n_features, weight, score,
       CASE WHEN p <= 10 * (SELECT count(*) FROM x WHERE n_features >= 20) // 100 THEN p END AS rank FROM k
"""


@query("op12_importance_resample", OP12_SQL)
def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


# the states are begin, system, user, assistant; each holds the least (cost, edits) way to the end and its turns
_WAY = "{{'c': {0}, 'a': '{1}' || {2}.a, 't': {3} || {2}.t}}"
_LINE, _AS_USER, _AS_ASSISTANT = "chr(10) || role || ':' || text", "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"


def _keep(first: str, to: str) -> str:
    return f"CASE WHEN NOT must AND left(role, 1) = '{first}' THEN {_WAY.format(f'pay + {to}.c', 'K', to, _LINE)} END"


def _rerole(to: str, line: str) -> str:
    return f"CASE WHEN NOT must THEN {_WAY.format(f'pay + 3 + {to}.c', 'R', to, line)} END"


def _delete(at: str) -> str:
    return _WAY.format(f"4 + {at}.c", "D", at, "''")


def _insert(to: str, role: str) -> str:
    return _WAY.format(f"3 + {to}.c", "I", to, f"chr(10) || '{role}:'")


OP13_SQL = f"""
WITH RECURSIVE st AS ({CRC_STEPS_SQL}),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT *, {CRC_SQL.format("k")} % 20 AS f FROM src, st),
dam AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
               CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM hit, range(2) t(n) WHERE f <> 0 AND (n = 0 OR f = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(0) || text), copy) AS i FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS copy,
               trim(text, {SPACE_SQL}) AS inner_text FROM dam)),
fa AS (SELECT *, CASE WHEN inner_text = '' THEN 1 WHEN copy > 1 THEN 2 WHEN right(inner_text, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
              left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM o),
ids AS (SELECT DISTINCT conv_id FROM conversations),
stats AS (
  SELECT ids.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids LEFT JOIN fa ON fa.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.conv_id),
r AS (
  SELECT conv_id, n AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS b, {{'c': 6::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s,
         {{'c': 3::BIGINT, 'a': 'I', 't': chr(10) || 'assistant:'}} AS u, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS a
  FROM stats
  UNION ALL
  SELECT conv_id, i, list_min([b, {_insert("u", "user")}]) AS b, list_min([s, {_insert("u", "user")}]) AS s, u, a FROM (
    SELECT conv_id, i, b, s, list_min([u, {_insert("a", "assistant")}]) AS u, list_min([a, {_insert("u", "user")}]) AS a FROM (
      SELECT r.conv_id, r.i - 1 AS i,
             list_min(list_filter([{_delete("b")}, {_keep("s", "s")}, {_keep("u", "u")}, {_rerole("u", _AS_USER)}], lambda x: x IS NOT NULL)) AS b,
             list_min(list_filter([{_delete("s")}, {_keep("u", "u")}, {_rerole("u", _AS_USER)}], lambda x: x IS NOT NULL)) AS s,
             list_min(list_filter([{_delete("u")}, {_keep("a", "a")}, {_rerole("a", _AS_ASSISTANT)}], lambda x: x IS NOT NULL)) AS u,
             list_min(list_filter([{_delete("a")}, {_keep("u", "u")}, {_rerole("u", _AS_USER)}], lambda x: x IS NOT NULL)) AS a
      FROM r JOIN (SELECT conv_id AS k, i AS at, role, text, fault IN (1, 2) AS must, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS pay FROM fa) x
        ON x.k IS NOT DISTINCT FROM r.conv_id AND x.at = r.i)))
SELECT r.conv_id, gaps, blank, duplicate, truncated, illegal, b.c AS cost, b.a AS audit, sha256(substr(b.t, 2)) AS repaired_sha256
FROM r JOIN stats ON stats.conv_id IS NOT DISTINCT FROM r.conv_id WHERE r.i = 0
"""


@query("op13_conversation_repair", OP13_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair_report(damaged_turns(turns), turns).drop("n_turns")
