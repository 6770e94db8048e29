"""Chunking, identity, redaction and URL queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.markdown import chunks
from quern.plans.common import Book
from quern.views import table

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles


@BOOK.query("chunk_prose")
def chunk_prose(spark, sf_dir):
    """Every document's chunks; no SQL form (stateful packing), tested by its invariants."""
    made = chunks(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "ordinal", "start", "end", F.sha2("text", 256).alias("content_sha256"))


@BOOK.query("chunk_identity", r"""WITH line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
  hashed AS (SELECT doc_id, pos, 'chunk:' || sha256(encode('chunk') || from_hex(lpad(hex(octet_length(encode(text))), 16, '0')) || encode(text)) AS content_hash FROM line WHERE trim(text) <> '')
  SELECT doc_id, CAST(pos AS BIGINT) AS ordinal, content_hash, CAST(row_number() OVER (PARTITION BY doc_id, content_hash ORDER BY pos) - 1 AS BIGINT) AS suffix FROM hashed""")
def chunk_identity(spark, sf_dir):
    """Lines' content hashes and the suffix that tells equal ones of a document apart."""
    line = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).filter(F.trim("text") != "")
    hashed = line.select("doc_id", (F.col("pos") + 1).cast("long").alias("ordinal"), T.domain_digest("chunk", F.col("text")).alias("content_hash"))
    return hashed.withColumn("suffix", (F.row_number().over(Window.partitionBy("doc_id", "content_hash").orderBy("ordinal")) - 1).cast("long"))


@BOOK.query("snippet_redact", r"""SELECT page_id, substring(regexp_replace(html, '(?i)(?:https?:)?//[^\s)\]>''"]*', '[link omitted]', 'g'), 1, 300) AS snippet FROM pages""")
def snippet_redact(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.snippet(F.col("html"), 300).alias("snippet"))


#: Without look-behind: what stands before a credential is matched and put back.
REDACTED = r"""WITH v AS (SELECT '(?:"(?:[^"\\]|\\.)*"?|''(?:[^''\\]|\\.)*''?|[^\s"''<>,;&)\]}]+)' AS value),
  a AS (SELECT conv_id, turn, value, regexp_replace(text, '(?is)(^|[^a-z0-9_-])(bearer\s+)' || value, '\1\2[REDACTED_SECRET]', 'g') AS t FROM conversations, v),
  b AS (SELECT conv_id, turn, regexp_replace(t, '(?is)(^|[^a-z0-9_-])((?:authorization|[a-z]+_token|client_secret|x-api-key|api_key|token|secret)["'']?\s*[:=]\s*)' || value, '\1\2[REDACTED_SECRET]', 'g') AS t FROM a),
  c AS (SELECT conv_id, turn, regexp_replace(t, '(?i)(^|[^a-z0-9_])(?:ntn_[a-z0-9_.-]+|secret_[a-z0-9_.-]*|sk-[a-z0-9_.-]{2,})', '\1[REDACTED_SECRET]', 'g') AS t FROM b),
  d AS (SELECT conv_id, turn, regexp_replace(t, '(?i)https?://[^\s"''<>]*', '[REDACTED_URL]', 'g') AS t FROM c)
  SELECT conv_id, turn, CASE WHEN length(t) > 4096 THEN substring(t, 1, 4096) || '[TRUNCATED]' ELSE t END AS redacted FROM d"""


@BOOK.query("log_redaction", REDACTED)
@BOOK.query("log_redaction_all", REDACTED)
def log_redaction(spark, sf_dir):
    """Every message, long ones cut."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.redacted(F.col("text")).alias("redacted"))


#: Signing marks by page: what is put into its address, and what of that must stay.
MARKS = {
    0: ("X-Amz-Date=20240101&a=1&X-Amz-Signature=ab", "a=1"),
    1: ("x-goog-signature=cd&X-Goog-Expires=9&X-Amz-Date=1", "X-Amz-Date=1"),
    2: ("b=2&X-Amz-SignedHeaders=host&X-AMZ-SIGNATURE=ef&X-Amz-Content-Sha256=7&c=?3", "b=2&X-Amz-Content-Sha256=7&c=?3"),
    3: ("X-Amz-Credential=q", "X-Amz-Credential=q"),
}
_KEPT = " ".join(f"WHEN {k} THEN '{kept}'" for k, (_, kept) in MARKS.items())
_FIRST, _REST = "regexp_extract(url, '^[^#]*')", "regexp_extract(url, '^[^#]*(#.*)$', 1)"
SIGNED_SQL = f"SELECT page_id, {_FIRST} || CASE WHEN contains({_FIRST}, '?') THEN '&' ELSE '?' END || CASE page_id % 4 {_KEPT} END || {_REST} AS canonical FROM pages"


@BOOK.query("signed_url_all", SIGNED_SQL)
def signed_url_all(spark, sf_dir):
    """Every page's address, whatever query or fragment it has, signed in one of four ways and made canonical again."""
    bare, fragment = F.regexp_extract("url", r"(?s)\A[^#]*", 0), F.regexp_extract("url", r"(?s)\A[^#]*(#.*)\z", 1)
    mark = F.when(F.contains(bare, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    put = F.element_at(F.array(*[F.lit(said) for said, _ in MARKS.values()]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.concat(bare, mark, put, fragment)).alias("canonical"))


_LISTS = {by: ", ".join(f"'{n}'" for n in names) for by, names in T.SIGNED.items()}
CANONICAL = f"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[^#]*') AS bare, regexp_extract(url, '^[^#]*(#.*)$', 1) AS fragment FROM pages),
  p AS (SELECT *, string_split(regexp_extract(bare, '^[^?]*[?](.*)$', 1), '&') AS parts FROM u),
  n AS (SELECT *, list_transform(parts, lambda x: lower(split_part(x, '=', 1))) AS names FROM p),
  k AS (SELECT *, array_to_string(list_filter(parts, lambda x: NOT (list_contains(names, 'x-amz-signature') AND lower(split_part(x, '=', 1)) IN ({_LISTS['amz']}) OR list_contains(names, 'x-goog-signature') AND lower(split_part(x, '=', 1)) IN ({_LISTS['goog']}))), '&') AS kept FROM n)
  SELECT page_id, CASE WHEN list_has_any(names, ['x-amz-signature', 'x-goog-signature'])
    THEN regexp_extract(bare, '^[^?]*') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END || fragment ELSE url END AS canonical FROM k"""


@BOOK.query("canonical_url", CANONICAL)
@BOOK.query("canonical_url_all", CANONICAL)
def canonical_url(spark, sf_dir):
    """Every page's address, signed ones without their signature."""
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


log_redaction_all, canonical_url_all = log_redaction, canonical_url

BOOK.sql("section_expand", """SELECT doc_id, substring(section, 1, 4000) AS text, length(section) > 4000 AS cut FROM (SELECT doc_id, coalesce(lang, '') || chr(10) || chr(10) || coalesce(text, '') AS section FROM documents) s""")
BOOK.sql("heading_prefix", "SELECT doc_id, coalesce(source, '') || ' / ' || coalesce(lang, '') || ' / ' || substring(coalesce(text, ''), 1, 40) AS path FROM documents")
