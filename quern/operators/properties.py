"""Typed properties and page metadata from the JSON that a page comes as.

A property says its type, and its value lies under that name: a union that is read by
schema, with a reason instead of a value where it can't be (``invalid``: not what its type
says; ``unsupported``: a type that isn't known, or a list that was cut). A page is refused
as a whole if any of it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.links import page_id, uuid

#: What a property becomes; only what its kind needs is set.
VALUE = "struct<kind:string,text:string,number:double,flag:boolean,start:string,end:string,items:array<string>>"
_FIELDS = {"text": "string", "number": "double", "flag": "boolean", "start": "string", "end": "string", "items": "array<string>"}
#: The types of properties: fixed values of the format.
TEXTS = ("url", "email", "phone_number", "created_time", "last_edited_time", "string")
NULLABLE = ("number", "select", "status", "date", "url", "email", "phone_number", "string")
RICH, NAMED, PEOPLE, NESTED = ("title", "rich_text"), ("select", "status"), ("created_by", "last_edited_by"), ("formula", "rollup")
OTHERS = ("number", "checkbox", "boolean", "multi_select", "date", "people", "relation")
KNOWN = (*TEXTS, *RICH, *NAMED, *PEOPLE, *NESTED, *OTHERS)
#: A list of mentions is cut at so many items.
CUT_AT = 25
_MAP = "map<string,string>"


def _value(kind: str, **said: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), *[said.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FIELDS.items()])


def _json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def _is(text: Column, mark: str) -> Column:
    """Whether raw JSON begins like a value of a type: { or [."""
    return F.coalesce(F.startswith(F.ltrim(text), F.lit(mark)), F.lit(False))


def _with(made: Column, use: Callable[[Column], Column]) -> Column:
    """use(made), with made reckoned once however often it is used."""
    return F.element_at(F.transform(F.array(made), use), 1)


def _strings(array: Column, field: str) -> Column:
    """The strings under a field of an array of objects; null if one has none."""
    # a value that is no string is read as its JSON text, so the raw text must hold it in quotes
    quoted = F.forall(_json(array, "array<string>"), lambda x: F.coalesce(F.rlike(x, F.lit(rf'"{field}"\s*:\s*"')), F.lit(False)))
    every = lambda rows: F.when(F.forall(rows, lambda x: x[field].isNotNull()) & quoted, F.transform(rows, lambda x: x[field]))
    return F.when(_is(array, "["), _with(_json(array, f"array<struct<{field}:string>>"), every))


def _ids(array: Column) -> Column:
    """The ids of an array of objects, sorted; null if one has none."""
    return _with(F.transform(_strings(array, "id"), uuid), lambda ids: F.when(F.forall(ids, lambda x: x.isNotNull()), F.sort_array(ids)))


def _in_quotes(parent: Column, name: Column) -> Column:
    """Whether a field stands in its parent's JSON as a string."""
    return F.coalesce(F.rlike(parent, F.concat(F.lit(r'"\Q'), name, F.lit(r'\E"\s*:\s*"'))), F.lit(False))


def _if_any(found: Column, made: Callable[[Column], Column]) -> Column:
    """made(found), found being reckoned once; null if it is null."""
    return _with(found, lambda x: F.when(x.isNotNull(), made(x)))


def _one(said: Column, deep: bool) -> Column:
    """(value VALUE, reason) of one property's JSON."""
    return _with(_parts(said), lambda p: _judged(p, deep))


def _parts(said: Column) -> Column:
    """(said, raw): one property's JSON, and its fields as a map."""
    return F.struct(said.alias("said"), _json(said, _MAP).alias("raw"))


def _judged(p: Column, deep: bool) -> Column:
    kind = F.try_element_at(p["raw"], F.lit("type"))
    return _with(F.struct(p["said"].alias("said"), p["raw"].alias("raw"), kind.alias("kind"), F.try_element_at(p["raw"], kind).alias("v")), lambda q: _read(q, deep))


def _read(p: Column, deep: bool) -> Column:
    """The same from a property that is read as a map already: (said, raw, kind, v), v being what lies under its type."""
    said, raw, kind, v = p["said"], p["raw"], p["kind"], p["v"]
    # lambdas are interpreted, and reckon an expression as often as it stands in them: each kind has one branch, and what that uses twice is bound
    there = F.coalesce(F.map_contains_key(raw, kind), F.lit(False))
    string = _in_quotes(said, kind)
    number = ~string & F.rlike(v, F.lit(r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"))
    name = F.when(_in_quotes(v, F.lit("name")), F.try_element_at(_json(v, _MAP), F.lit("name")))
    date = F.when(_in_quotes(v, F.lit("start")), _json(v, "struct<start:string,end:string>"))
    end_ok = lambda d: d["end"].isNull() | F.rlike(v, F.lit(r'"end"\s*:\s*"'))
    person = uuid(F.try_element_at(_json(v, _MAP), F.lit("id")))
    more = F.try_element_at(raw, F.lit("has_more"))
    size = F.coalesce(F.size(_json(v, "array<string>")), F.lit(0))
    mentions = F.size(F.filter(_json(v, "array<struct<type:string>>"), lambda x: x["type"] == "mention"))
    cut = (kind.isin("people", "relation") & ((more == "true") | ((kind == "people") & (size >= CUT_AT)))) | (kind.isin(*RICH) & (mentions >= CUT_AT))
    made = (
        F.when(there & v.isNull() & kind.isin(*NULLABLE), _value("null"))
        .when(kind.isin(*TEXTS), F.when(v.isNotNull() & string, _value("text", text=v)))
        .when(kind.isin(*RICH), _if_any(_strings(v, "plain_text"), lambda x: _value("text", text=F.array_join(x, ""))))
        .when(kind == "number", F.when(number, _value("number", number=v.try_cast("double"))))
        .when(kind.isin("checkbox", "boolean"), F.when(~string & v.isin("true", "false"), _value("flag", flag=v == "true")))
        .when(kind.isin(*NAMED), _if_any(name, lambda x: _value("text", text=x)))
        .when(kind == "multi_select", _if_any(_strings(v, "name"), lambda x: _value("strings", items=F.sort_array(x))))
        .when(kind == "date", _with(date, lambda d: F.when(d["start"].isNotNull() & end_ok(d), _value("date", start=d["start"], end=d["end"]))))
        .when(kind == "people", _if_any(_ids(v), lambda x: _value("person_ids", items=x)))
        .when(kind == "relation", F.when(F.coalesce(more.isin("true", "false"), F.lit(False)), _if_any(_ids(v), lambda x: _value("page_ids", items=x))))
        .when(kind.isin(*PEOPLE), _if_any(person, lambda x: _value("person_ids", items=F.array(x))))
    )
    unknown = kind.isNotNull() & ~kind.isin(*(KNOWN if deep else [k for k in KNOWN if k not in NESTED]))
    judged = lambda q: F.struct(F.when(~q["cut"], q["made"]).alias("value"), F.when(unknown | q["cut"], "unsupported").when(q["made"].isNull(), "invalid").alias("reason"))
    plain = _with(F.struct(made.alias("made"), F.coalesce(cut, F.lit(False)).alias("cut")), judged)
    if not deep:
        return plain
    return F.when(kind.isin(*NESTED) & _is(v, "{"), _one(v, False)).otherwise(plain)


def typed(said: Column) -> Column:
    """struct<value, reason> of a property's JSON; a formula or rollup is what its result is."""
    return _one(said, True)


def page_metadata(pages: DataFrame, key: str, json: str, hosts: list[str]) -> DataFrame:
    """(key, reason, id, url, title, last_edited_time, archived, properties map<id, VALUE>, relations map<id, name>) of pages' JSON.

    reason is null for a page that is taken, and then all is set: it is an object ``page``
    with a valid id that its url names as well, an instant, at least one of in_trash,
    is_archived and archived (all booleans; archived if any is true), and properties
    with distinct ids that aren't empty, of which exactly one is a title. Of several
    reasons the first property's by name counts; null and broken JSON is invalid.
    """
    schema = "struct<object:string,id:string,url:string,last_edited_time:string,in_trash:string,is_archived:string,archived:string,properties:map<string,string>>"
    df = pages.select(key, _json(F.col(json), schema).alias("p"))
    entries = F.sort_array(F.map_entries(F.coalesce(F.col("p.properties"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))

    def one(e: Column) -> Column:
        of = lambda p, field: F.try_element_at(p["raw"], F.lit(field)).alias(field)
        return _with(_parts(e["value"]), lambda p: F.struct(e["key"].alias("name"), of(p, "id"), of(p, "type"), _judged(p, True).alias("t")))

    df = df.withColumn("_read", F.transform(entries, one))
    first = F.try_element_at(F.filter("_read", lambda x: x["t"]["reason"].isNotNull()), F.lit(1))["t"]["reason"]
    ids = F.transform("_read", lambda x: x["id"])
    titles = F.filter("_read", lambda x: x["type"] == "title")
    flags = F.array(*[F.col(f"p.{c}") for c in ("in_trash", "is_archived", "archived")])
    given = F.filter(flags, lambda x: x.isNotNull())
    own = uuid(F.col("p.id"))
    fine = (
        (F.col("p.object") == "page") & own.isNotNull() & (page_id(F.col("p.url"), hosts) == own) & F.try_to_timestamp("p.last_edited_time").isNotNull()
        & F.rlike("p.last_edited_time", F.lit(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$"))
        & (F.size(given) > 0) & F.forall(given, lambda x: x.isin("true", "false"))
        & F.forall(ids, lambda x: F.coalesce(x != "", F.lit(False))) & (F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(titles) == 1)
    )
    reason = F.coalesce(first, F.when(~F.coalesce(fine, F.lit(False)), "invalid"))
    only = lambda c: F.when(F.col("reason").isNull(), c)
    df = df.withColumn("reason", reason)
    pairs = lambda rows, of: F.map_from_entries(F.transform(rows, lambda x: F.struct(x["id"].alias("key"), of(x).alias("value"))))
    return df.select(
        key, "reason", only(own).alias("id"), only(F.col("p.url")).alias("url"), only(F.try_element_at(titles, F.lit(1))["t"]["value"]["text"]).alias("title"), only(F.col("p.last_edited_time")).alias("last_edited_time"),
        only(F.array_contains(given, "true")).alias("archived"),
        only(pairs(F.col("_read"), lambda x: x["t"]["value"])).alias("properties"),
        only(pairs(F.filter("_read", lambda x: x["type"] == "relation"), lambda x: x["name"])).alias("relations"),
    )
