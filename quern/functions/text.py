"""Text and URL scalars as Column expressions, and the few that need Python."""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed markers.
LINK_REMOVED = "[link omitted]"
URL_REMOVED, SECRET_REMOVED, CUT = "[REDACTED_URL]", "[REDACTED_SECRET]", "[TRUNCATED]"
#: Query parameters of signed URLs, by provider, in lower case (fixed values of the providers' formats).
SIGNED = {
    "amz": ("x-amz-algorithm", "x-amz-credential", "x-amz-date", "x-amz-expires", "x-amz-security-token", "x-amz-signature", "x-amz-signedheaders"),
    "goog": ("x-goog-algorithm", "x-goog-credential", "x-goog-date", "x-goog-expires", "x-goog-signature", "x-goog-signedheaders"),
}
_LINK = re.compile(r"""((?:https?:)?//[^\s)\]>'"]*)""", re.IGNORECASE)


def _percent_decoded(text: str) -> str:
    return unquote_to_bytes(text).decode("utf-8", "replace")


def _safe_token(token: str) -> str:
    """A token (with the blank after it) without link targets, plain or encoded."""
    parts = _LINK.split(token)
    for k, part in enumerate(parts):
        if k % 2:
            parts[k] = LINK_REMOVED
        else:
            plain = _percent_decoded(part).lower().replace("&amp;", "&")
            if "http:" in plain or "https:" in plain or "//" in plain:
                parts[k] = LINK_REMOVED + (" " if k == len(parts) - 1 and part[-1].isspace() else "")
    return "".join(parts)


def snippet(text: Column, length: int) -> Column:
    """The first ``length`` characters once every link target, also an encoded one, is replaced."""

    @F.pandas_udf(StringType())
    def cut(texts: pd.Series) -> pd.Series:
        def one(said: str | None) -> str | None:
            if said is None:
                return None
            out, n = [], 0
            for token in re.finditer(r"\S*\s?", said):  # no further than the snippet needs
                out.append(_safe_token(token[0]) if token[0] else "")
                n += len(out[-1])
                if n >= length:
                    break
            return "".join(out)[:length]

        return texts.map(one)

    return cut(text)


def normalised_lines(text: Column) -> Column:
    """Line ends as line feeds, without outer ones."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\A\n+|\n+\z", "")


_VALUE = r"""(?:"(?:[^"\\]|\\.)*"?|'(?:[^'\\]|\\.)*'?|[^\s"'<>,;&)\]}]+)"""
#: Keys before a credential (fixed values).
_KEYS = r"authorization|[a-z]+_token|client_secret|x-api-key|api_key|token|secret"


def redacted(text: Column, most: int = 4096) -> Column:
    """Credentials after a key or ``bearer``, token forms and URLs as markers, keys kept; cut with a suffix."""
    c = F.regexp_replace(text, rf"(?is)(?<![a-z0-9_-])(bearer\s+){_VALUE}", f"$1{SECRET_REMOVED}")
    c = F.regexp_replace(c, rf"(?is)(?<![a-z0-9_-])(authorization[\"']?\s*[:=]\s*)[a-z0-9-]+\s+{_VALUE}", f"$1{SECRET_REMOVED}")
    c = F.regexp_replace(c, rf"(?is)(?<![a-z0-9_-])((?:{_KEYS})[\"']?\s*[:=]\s*)(?!\[REDACTED_SECRET\]){_VALUE}", f"$1{SECRET_REMOVED}")
    c = F.regexp_replace(c, r"(?i)(?<![a-z0-9_])(?:ntn_[a-z0-9_.-]+|secret_[a-z0-9_.-]*|sk-[a-z0-9_.-]{2,})", SECRET_REMOVED)
    c = F.regexp_replace(c, r"""(?i)https?://[^\s"'<>]*""", URL_REMOVED)
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(CUT))).otherwise(c)


def canonical_url(url: Column) -> Column:
    """A signed http(s) URL without the signing provider's parameters; any other URL, and all else, as it is."""
    bare = F.regexp_extract(url, r"(?s)\A[^#]*", 0)
    parts = F.split(F.regexp_extract(bare, r"(?s)\A[^?]*\?(.*)\z", 1), "&")
    name = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    signs = lambda by: F.exists(parts, lambda p: name(p) == f"x-{by}-signature")
    signed = {by: signs(by) for by in SIGNED}
    gone = lambda p: (signed["amz"] & name(p).isin(*SIGNED["amz"])) | (signed["goog"] & name(p).isin(*SIGNED["goog"]))
    kept = F.filter(parts, lambda p: ~gone(p))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    made = F.concat(F.regexp_extract(bare, r"(?s)\A[^?]*", 0), query, F.substring(url, F.length(bare) + 1, F.length(url)))
    return F.when(F.rlike(url, F.lit("(?i)^https?://")) & (signed["amz"] | signed["goog"]), made).otherwise(url)


def array_digest(domain: str, parts: Column) -> Column:
    """domain_digest of the strings of an array."""
    framed = F.aggregate(parts, F.lit(domain).cast("binary"), lambda acc, p: F.concat(acc, F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), p.cast("binary")))
    return F.concat(F.lit(f"{domain}:"), F.sha2(framed, 256))


def domain_digest(domain: str, *parts: Column) -> Column:
    """SHA-256 over a domain and length-prefixed parts, as 'domain:hex'."""
    raw = F.encode(F.lit(domain), "UTF-8")
    for part in parts:
        size = F.unhex(F.lpad(F.hex(F.octet_length(part).cast("long")), F.lit(16), F.lit("0")))
        raw = F.concat(raw, size, F.encode(part, "UTF-8"))
    return F.concat(F.lit(f"{domain}:"), F.sha2(raw, 256))


@F.pandas_udf(StringType())
def percent_decoded(text: pd.Series) -> pd.Series:
    """%XX as bytes, malformed ones kept, bad UTF-8 replaced; Spark's own decoder also turns + into a space."""
    return text.map(lambda s: None if s is None else _percent_decoded(s))
