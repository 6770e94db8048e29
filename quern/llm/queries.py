"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import chat, jaccard, langid, mixture, ngram, paragraphs, periods, pieces, pii, repair, rollups, smallworld, transport
from quern.llm.shared import shared_dir, table, tokenizer_file


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).selectExpr("-1L conv_id", "id turn", "if(id = 0, 'user', 'assistant') role", f"'{said}' text")
    return chat.format_digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digest(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, toxic ones deleted, those of low quality counted anew; then a second tokenizer version; two batches come twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    marked = docs.join(labels, "doc_id")
    toxic = rollups.changes(labels.filter("toxic = 1").select("doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(0).alias("tokens")), "words@1", rollups.DELETE)
    revised = rollups.changes(rollups.counts(marked.filter("quality = 0"), "letters@2"), "words@1", rollups.REVISE)
    totals = rollups.Rollup(spark, shared_dir(spark, "rollups"))
    totals.commit("load", rollups.changes(rollups.counts(docs, "words@1"), "words@1", rollups.INSERT))
    totals.commit("toxic", toxic)
    totals.commit("recount", revised)
    totals.commit("toxic", toxic)
    totals.commit("second-version", rollups.changes(rollups.counts(docs, "letters@2"), "letters@2", rollups.INSERT))
    totals.commit("recount", revised)
    return totals.totals()


def op4_transport_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.media_digest(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_documents(table(spark, sf_dir, "documents"))


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.removed_spans(table(spark, sf_dir, "documents"))


def op9_vector_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smallworld.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.taken(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_digest(repair.damaged(given), given)


def op12_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periods.run_digest(docs.select("doc_id", periods.looped(F.col("text"), F.col("doc_id")).alias("text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_piece_codec": op2_piece_codec,
        "op3_token_rollups": op3_token_rollups,
        "op4_transport_media": op4_transport_media,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_language_id": op6_language_id,
        "op7_kneser_ney": op7_kneser_ney,
        "op8_paragraph_dedup": op8_paragraph_dedup,
        "op9_vector_near_dups": op9_vector_near_dups,
        "op10_source_mixture": op10_source_mixture,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_pii_spans": op12_pii_spans,
        "op13_periodic_runs": op13_periodic_runs,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op3_token_rollups": OP3_SQL, "op11_conversation_repair": OP11_SQL}


#: The learned text and the turns straight from the table; what escaping adds is counted, as in the template.
OP1_SQL = r"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS shown,
    length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A')) AS role_shown
  FROM own),
judged AS (
  SELECT *, CASE role
      WHEN 'system' THEN before IS NULL
      WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
      WHEN 'assistant' THEN before IS NOT NULL AND before IN ('user', 'tool')
      WHEN 'tool' THEN before IS NOT NULL AND before IN ('user', 'assistant', 'tool')
      ELSE FALSE END AS allowed
  FROM ranked),
grouped AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS learned,
    sum(shown + role_shown + 12 + 1 + 11) AS formatted_chars,
    min(pos) FILTER (NOT allowed) AS broken, last(role ORDER BY pos) AS final
  FROM judged GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256,
  CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars,
  broken IS NULL AND final = 'assistant' AS valid,
  CAST(coalesce(broken, CASE WHEN final <> 'assistant' THEN n_turns END) AS BIGINT) AS rejected_at
FROM grouped
"""

OP3_SQL = r"""
WITH counted AS (
  SELECT doc_id, source, lang,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+')) AS BIGINT) AS letters
  FROM documents),
marked AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id)
SELECT source, lang, 'words@1' AS tokenizer, CAST(count(*) AS BIGINT) AS docs,
  CAST(sum(CASE WHEN quality = 0 THEN letters ELSE words END) AS BIGINT) AS tokens
FROM counted LEFT JOIN marked USING (doc_id) WHERE coalesce(toxic, 0) <> 1 GROUP BY source, lang
UNION ALL
SELECT source, lang, 'letters@2', CAST(count(*) AS BIGINT), CAST(sum(letters) AS BIGINT) FROM counted GROUP BY source, lang
"""

def crc32_sql(text: str) -> str:
    """crc32 of a text of ASCII characters as DuckDB reckons it, bit by bit."""
    bit = "list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: {bit}), 4294967295)"


#: The cheapest edits forwards, turn by turn: of each state's ways the least by cost, then by letters. ins has up to two
#: turns put in before a turn (or at the end), act what may be done with it.
OP11_SQL = rf"""
WITH RECURSIVE own AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM own, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS earlier
  FROM hurt),
judged AS (
  SELECT *, role[1:1] AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM placed),
marked AS (
  SELECT *, blank OR again AS go, CASE WHEN NOT blank AND NOT again AND cut THEN 1 ELSE 0 END AS open FROM judged),
counted AS (
  SELECT conv_id, count(*) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, CAST(sum(open) AS BIGINT) AS truncated,
    count(*) FILTER (pos > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id),
step(state, role, onward) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
ins AS (
  SELECT state, state AS onward, 0 AS cost, '' AS letters, CAST([] AS VARCHAR[]) AS said FROM step
  UNION ALL SELECT state, onward, 2, 'I', [role || ':'] FROM step
  UNION ALL SELECT a.state, b.onward, 4, 'II', [a.role || ':', b.role || ':'] FROM step a JOIN step b ON a.onward = b.state),
act(state, initial, onward) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, struct_pack(cost := 0, letters := '', said := CAST([] AS VARCHAR[])) AS best FROM counted
  UNION ALL
  SELECT conv_id, pos, state, min(struct_pack(cost := cost, letters := letters, said := said)) FROM (
    SELECT w.conv_id, m.pos, d.onward AS state, w.best.cost + i.cost + d.cost AS cost, w.best.letters || i.letters || d.letter AS letters, w.best.said || i.said || d.said AS said
    FROM walk w JOIN marked m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND m.pos = w.pos + 1 JOIN ins i ON i.state = w.state,
      LATERAL (
        SELECT i.onward AS onward, 3 AS cost, 'D' AS letter, CAST([] AS VARCHAR[]) AS said
        UNION ALL SELECT s.onward, 2 + m.open, 'R', [s.role || ':' || m.text] FROM step s WHERE s.state = i.onward AND NOT m.go
        UNION ALL SELECT a.onward, m.open, 'K', [m.role || ':' || m.text] FROM act a WHERE a.state = i.onward AND a.initial = m.initial AND NOT m.go) d)
  GROUP BY conv_id, pos, state),
done AS (
  SELECT w.conv_id, min(struct_pack(cost := w.best.cost + i.cost, letters := w.best.letters || i.letters, said := w.best.said || i.said)) AS best
  FROM walk w JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.pos = c.n JOIN ins i ON i.state = w.state AND i.onward IN (0, 3)
  GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.letters, '') AS audit,
  sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON o.conv_id IS NOT DISTINCT FROM d.conv_id
"""
