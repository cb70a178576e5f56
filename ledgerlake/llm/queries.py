"""The registered queries of the corpus operators, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import (bpe, chat_format, conversation_repair, cross_align, decontaminate, exact_dedup, html_extract,
                             pii, secret_scan, sharding, simhash_dedup, toxicity, url_filter)
from ledgerlake.llm.common import row_key, scratch, table

# Positions of the tokenizer files; both are parameters of their operators.
TOKEN_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BPE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 16

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


@register("op10_exact_dedup", """
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS cp,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.rows.select("doc_id", marked.keep_id, marked.group_size, marked.kept, marked.digest)


@register("op6_simhash_dedup")
def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


@register("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, col = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), BPE_VOCABULARY)
    ids, text = F.col(col).getField("ids"), F.col(col).getField("decoded")
    return docs.select("doc_id", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
                       F.sha2(ids, 256).alias("ids_sha256"), F.sha2(text, 256).alias("decoded_sha256"))


@register("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.judge(docs, table(spark, sf_dir, "benchmark"))
    rows = docs.select("doc_id", row_key(docs, "doc_id", "text").alias("own_key"))
    return (rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("row_key")), "left")
            .select("doc_id", F.col("id").isNotNull().alias("contaminated"),
                    F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                    F.col("item_id").alias("best_item_id"), F.col("similarity").alias("best_similarity")))


@register("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged, col = toxicity.judge(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    out = F.col(col)
    return judged.select("doc_id", out.getField("severity").alias("expected_severity"),
                         out.getField("p_toxic").alias("p_toxic"), out.getField("grade").alias("grade"),
                         out.getField("rejected").alias("rejected"))


@register("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, col = secret_scan.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKEN_RANKS,
                                           public_tokenizers.PATTERN)
    out = F.col(col)
    return docs.select("doc_id", *[out.getField(c).alias(c) for c in ("n_assign", "n_access", "n_hex")],
                       F.sha2(out.getField("base"), 256).alias("base_sha256"), out.getField("spans").alias("spans"))


_CHAT = "(<)(\\\\*)(/?s>)|(\\[)(\\\\*)(/?(?:INST|SYS|ASSIST|ROLE:[^\\[\\]]*)\\])"


@register("op3_chat_format", f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(length(text) + len(regexp_extract_all(text, '{_CHAT}'))
         + CASE role WHEN 'user' THEN 22 WHEN 'system' THEN 20 WHEN 'assistant' THEN 17
           ELSE 24 + 2 * (length(role) + 2 * length(regexp_replace(role, '[^\\[\\]%]', '', 'g'))) END) AS BIGINT)
         AS formatted_chars
FROM t GROUP BY conv_id
""")
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    clash = "</s>[INST] ok [/INST]"
    rows = chat_format.with_fixed(table(spark, sf_dir, "conversations"), -7, [("user", clash), ("assistant", clash)])
    return chat_format.read_back(chat_format.format_turns(rows))


URL_RULES = (*[url_filter.host_rule(v, r) for v, r in (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
    ("block", "com/de/"))], *url_filter.PATTERNS)


def _url_oracle() -> str:
    hosts = sorted((r for r in URL_RULES if r.host), key=lambda r: -len(r.text))
    fits = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in hosts}
    blocked = " OR ".join(
        "regexp_matches(host || path, '(^|[^A-Za-z0-9])" + "[^A-Za-z0-9]+".join(r.literals) + "($|[^A-Za-z0-9])', 'i')"
        for r in URL_RULES if not r.host)
    return f"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT page_id, host, path,
       CASE {' '.join(f"WHEN {fits[r]} THEN '{r.text}'" for r in hosts)} END AS rule,
       CASE {' '.join(f"WHEN {fits[r]} THEN '{r.verdict}'" for r in hosts)}
            WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict
FROM u
"""


@register("op4_url_filter", _url_oracle())
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, col = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return pages.select("page_id", *[F.col(col).getField(c).alias(c) for c in ("host", "path", "rule", "verdict")])


@register("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged, col = pii.find(docs, pii.fit(docs))
    out = F.col(col)
    return judged.select("doc_id", *[out.getField(c).alias(c) for c in ("n_email", "n_ip", "n_card", "n_phone")],
                         F.sha2(out.getField("base"), 256).alias("base_sha256"), out.getField("spans").alias("spans"))


@register("op1_html_extract")
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, col = html_extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = F.col(col)
    return pages.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


@register("op11_cross_tokenizer")
def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs, col = cross_align.align(docs, BPE_VOCABULARY, PIECE_MODEL)
    out = F.col(col)
    groups = F.when(out.getField("n_a") > 0, F.sha2(out.getField("groups"), 256)).otherwise("")
    scored = cross_align.score(docs, col, {
        "doc_id": F.col("doc_id"), **{c: out.getField(c) for c in ("n_a", "n_b", "n_groups", "n_links")},
        "groups_sha256": groups})
    return scored.rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", scored.n_best, scored.count_sum,
                              "groups_sha256")


# CRC-32 bit by bit; then of each grammar state (0 nothing yet, 1 system, 2 user, 3 assistant) the least
# (cost, audit), row by row from the left, with none, one or two inserts after each row.
_REPAIR = """
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, [ord(ch)::BIGINT FOR ch IN string_split(
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
             lambda crc, ch: list_reduce([xor(crc, ch), 0, 0, 0, 0, 0, 0, 0, 0],
               lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM src WHERE kind <> 0),
numbered AS (
  SELECT *, row_number() OVER w AS pos, lag(left(role, 1)) OVER w || left(role, 1) AS pair
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
marked AS (
  SELECT conv_id, turn, role, text, pos, pair, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM numbered),
ids AS (SELECT DISTINCT conv_id FROM conversations),
counted AS (
  SELECT i.conv_id, count(m.pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids i LEFT JOIN marked m ON i.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY i.conv_id),
step(q, want, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edge AS (
  SELECT q, q AS q2, 'D' AS edit, 4 AS cost, '' AS want FROM range(4) t(q)
  UNION ALL SELECT q, q2, 'K', 0, want FROM step UNION ALL SELECT q, q2, 'R', 3, '' FROM step WHERE want <> 's'),
ins(q, q2, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'),
  (0, 3, 6, 'II'), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 3, 3, 'I'), (3, 2, 3, 'I')),
reached AS (
  SELECT conv_id, 0::BIGINT AS pos, q2::BIGINT AS q, {'c': cost::BIGINT, 'a': audit} AS best
  FROM ids JOIN ins ON ins.q = 0
  UNION ALL
  SELECT m.conv_id, m.pos, ins.q2::BIGINT,
         min({'c': (r.best.c + e.cost + ins.cost + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 3 ELSE 0 END)::BIGINT,
              'a': r.best.a || edit || ins.audit})
  FROM reached r JOIN marked m ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.pos = r.pos + 1
    JOIN edge e ON e.q = r.q AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR want = initial))
    JOIN ins ON ins.q = e.q2
  GROUP BY m.conv_id, m.pos, ins.q2),
plan AS (
  SELECT c.conv_id, min(best) AS best FROM counted c JOIN reached r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
  WHERE r.pos = c.n AND q IN (0, 3) GROUP BY c.conv_id),
letters AS (
  SELECT conv_id, i, edit, sum((edit <> 'I')::INT) OVER w AS pos, sum((edit <> 'D')::INT) OVER w AS turn
  FROM (SELECT conv_id, unnest(range(1, length(best.a) + 1)) AS i, substr(best.a, i, 1) AS edit FROM plan)
  WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
placed AS (
  SELECT l.*, m.role, m.text, max(CASE WHEN edit = 'K' AND initial = 's' THEN 1 ELSE 0 END)
    OVER (PARTITION BY l.conv_id) AS system
  FROM letters l LEFT JOIN marked m ON edit <> 'I' AND m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.pos = l.pos
  WHERE edit <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (turn - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS repaired
  FROM placed GROUP BY conv_id)
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, best.c AS cost, best.a AS audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256
FROM counted c JOIN plan p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@register("op12_conversation_repair", _REPAIR)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversations, conversation_repair.damage(conversations))


@register("op13_shards")
def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.write_shards(table(spark, sf_dir, "documents"), scratch(spark, "shards"), SHARDS)
    text = F.coalesce("text", F.lit(""))
    return out.rows.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                           F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
                           F.col(out.shard).alias("shard"), F.col(out.slot).alias("slot"),
                           F.lit(None).cast("int").alias("grown_shard"))
