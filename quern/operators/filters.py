"""Request filters as Column expressions: validated first, with messages that never repeat the input, then applied before any ranking.

A metadata row has page_id, root_id, workspace_id, database_id, data_source_id, last_edited
(RFC 3339 text) and properties, a map from property id to a struct PROPERTY.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind: null, text, number, flag, date, strings, page_ids or person_ids.
PROPERTY = "struct<kind:string,text:string,number:double,flag:boolean,start:string,items:array<string>>"
LISTS = ("strings", "page_ids", "person_ids")
# Fixed bounds of requests.
MOST_IDS, MOST_ID_CHARS, MOST_PROPERTIES, MOST_QUERY_CHARS, MOST_LIMIT = 100, 128, 20, 4096, 100
BUDGET_BYTES = 512 * 1024
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")


class Refused(ValueError):
    """A request out of bounds."""


@dataclass(frozen=True)
class Equals:
    id: str
    kind: str
    value: object = None


@dataclass(frozen=True)
class Contains:
    id: str
    value: str


@dataclass(frozen=True)
class Dated:
    id: str
    begin: str | None = None
    until: str | None = None


@dataclass(frozen=True)
class Filters:
    page_id: tuple[str, ...] | None = None
    root_id: tuple[str, ...] | None = None
    workspace_id: tuple[str, ...] | None = None
    database_id: tuple[str, ...] | None = None
    data_source_id: tuple[str, ...] | None = None
    #: standalone or database
    kind: str | None = None
    edited: tuple[str | None, str | None] | None = None
    properties: tuple[Equals | Contains | Dated, ...] = ()


ID_LISTS = ("page_id", "root_id", "workspace_id", "database_id", "data_source_id")


def instant(text: str) -> datetime:
    """An RFC 3339 instant with an offset, or a date for its midnight in UTC."""
    if len(text) > MOST_ID_CHARS:
        raise Refused("an instant is too long")
    try:
        made = datetime.fromisoformat(f"{text}T00:00:00Z" if len(text) == 10 else text)
    except ValueError:
        raise Refused("an instant can't be read") from None
    if made.tzinfo is None:
        raise Refused("an instant has no offset")
    return made


def _check_range(begin: str | None, until: str | None) -> None:
    if begin is None and until is None:
        raise Refused("a range has no bound")
    if begin is not None and until is not None and instant(begin) >= instant(until):
        raise Refused("a range is empty")
    for bound in (begin, until):
        if bound is not None:
            instant(bound)


def checked(filters: Filters) -> Filters:
    """The filters, or Refused."""
    for name in ID_LISTS:
        ids = getattr(filters, name)
        if ids is not None:
            if not 1 <= len(ids) <= MOST_IDS:
                raise Refused("an id list has too few or too many ids")
            if any(not x.strip() or len(x) > MOST_ID_CHARS or _CONTROL.search(x) for x in ids):
                raise Refused("an id is blank, too long or has control characters")
    if filters.kind not in (None, "standalone", "database"):
        raise Refused("a page kind is unknown")
    if filters.edited is not None:
        _check_range(*filters.edited)
    if len(filters.properties) > MOST_PROPERTIES:
        raise Refused("there are too many property predicates")
    for p in filters.properties:
        if not p.id.strip() or len(p.id) > MOST_ID_CHARS:
            raise Refused("a property id is blank or too long")
        if isinstance(p, Dated):
            _check_range(p.begin, p.until)
    return filters


def check_query(text: str, limit: int) -> None:
    if not text.strip() or len(text) > MOST_QUERY_CHARS:
        raise Refused("the query is blank or too long")
    if not 1 <= limit <= MOST_LIMIT:
        raise Refused("the limit is out of range")


def _within(at: Column, begin: str | None, until: str | None) -> Column:
    bounds = [at >= F.lit(instant(begin))] if begin is not None else []
    bounds += [at < F.lit(instant(until))] if until is not None else []
    return reduce(Column.__and__, bounds)


def property_predicate(p: Equals | Contains | Dated, properties: Column) -> Column:
    """Type and value equality, membership in lists, or a half-open range on a date's start; a missing property never matches."""
    own = F.try_element_at(properties, F.lit(p.id))
    if isinstance(p, Contains):
        return own["kind"].isin(*LISTS) & F.array_contains(own["items"], p.value)
    if isinstance(p, Dated):
        start = own["start"]
        at = F.try_to_timestamp(F.when(F.length(start) == 10, F.concat(start, F.lit("T00:00:00Z"))).otherwise(start))
        return (own["kind"] == "date") & _within(at, p.begin, p.until)
    same = own["kind"] == p.kind
    if p.kind == "null":
        return same
    field = {"text": "text", "number": "number", "flag": "flag", "date": "start"}.get(p.kind, "items")
    value = F.array(*[F.lit(x) for x in p.value]) if field == "items" else F.lit(p.value)
    return same & (own[field] == value)


def predicate(filters: Filters) -> Column:
    """All filters at once; unknown counts as no."""
    checked(filters)
    found = [F.col(name).isin(*getattr(filters, name)) for name in ID_LISTS if getattr(filters, name) is not None]
    if filters.kind:
        alone = F.col("database_id").isNull() & F.col("data_source_id").isNull()
        found.append(alone if filters.kind == "standalone" else ~alone)
    if filters.edited is not None:
        found.append(_within(F.try_to_timestamp(F.col("last_edited")), *filters.edited))
    found += [property_predicate(p, F.col("properties")) for p in filters.properties]
    return F.coalesce(reduce(Column.__and__, found, F.lit(True)), F.lit(False))


def narrowed_roots(asked: list[str] | None, configured: list[str]) -> list[str]:
    """The configured roots that were asked for, in order; an empty list is an empty result."""
    return [r for r in configured if asked is None or r in asked]


def exclusion(page: Column, ancestors: Column, source: Column, pages: list[str], below: list[str], sources: list[str]) -> Column:
    """Why a page is left out, the first reason of three; null if it isn't."""
    below_any = F.arrays_overlap(F.concat(F.array(page), ancestors), F.array(*[F.lit(x) for x in below]).cast("array<string>")) if below else F.lit(False)
    return F.when(page.isin(*pages), "excluded_page").when(below_any, "excluded_descendant").when(source.isin(*sources), "excluded_source")


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """rows, or Refused where there are more than ``most``: a bounded pre-filter fails rather than cuts."""
    if rows.limit(most + 1).count() > most:
        raise Refused("the filter keeps too many rows")
    return rows


def projected(rows: DataFrame, text: str, chars: int = 2000, phrase: str | None = None) -> DataFrame:
    """rows with their text cut to ``chars``, whether it was cut, and whether the whole text holds the phrase."""
    whole = F.col(text)
    said = F.contains(F.lower(whole), F.lit(phrase.lower())) if phrase else F.lit(True)
    return rows.withColumns({"overflow": F.coalesce(F.length(whole) > chars, F.lit(False)), "says_phrase": F.coalesce(said, F.lit(False)), text: F.left(whole, F.lit(chars))})


def within_budget(result: DataFrame, most: int = BUDGET_BYTES) -> DataFrame:
    """result, or Refused where it takes more bytes as JSON."""
    size = result.select(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in result.columns]))))).first()[0]
    if (size or 0) > most:
        raise Refused("the result is too large")
    return result


def valid_hits(hits: DataFrame, text: str | None = None) -> DataFrame:
    """hits (page_id, chunk_id, score), or Refused for the whole query where one has no id, a score that isn't finite, a long text or a key twice."""
    bad = F.col("page_id").isNull() | F.col("chunk_id").isNull() | F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    if text:
        bad |= F.length(text) > 2000
    n, wrong, keys = hits.agg(F.count("*"), F.count_if(bad), F.count_distinct("page_id", "chunk_id")).first()
    if wrong or keys != n:
        raise Refused("a hit is malformed or comes twice")
    return hits
