"""Dictionary-expanded lexical search: query forms, a plan of phrases, evidence and its order.

The query is one short text, so it is parsed on the driver; the dictionary and the chunks
stay DataFrames.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed bounds of a plan.
MOST_WORDS, MOST_UNIT_WORDS, MOST_UNITS, MOST_TARGETS, MOST_PHRASES, MOST_WORD_CHARS, MOST_EVIDENCE = 128, 4, 8, 4, 8, 64, 20
_PAGE_ID = re.compile(r"[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}", re.IGNORECASE)
_CHUNK_ID = re.compile(r"[a-z][a-z-]*:[0-9a-f]{64}(?::[0-9]+)?")


def quoted_phrase(query: str) -> str | None:
    """What a query in double quotes says, if it is one phrase."""
    said = query.strip()
    inner = said[1:-1] if len(said) > 2 and said[0] == said[-1] == '"' else ""
    return inner.strip() if inner.strip() and '"' not in inner else None


def is_identifier(query: str) -> bool:
    """Whether a query has the form of a page's or a chunk's id."""
    said = query.strip()
    return bool(_PAGE_ID.fullmatch(said) or _CHUNK_ID.fullmatch(said))


def literal(text: str) -> str | None:
    """A dictionary form: composed and lower-cased, 1 to 4 words of letters and marks; None for any other text."""
    made = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower())
    words = made.split()
    fits = 1 <= len(words) <= MOST_UNIT_WORDS and all(len(w) <= MOST_WORD_CHARS and all(unicodedata.category(c)[0] in "LM" for c in w) for w in words)
    return " ".join(words) if fits else None


#: A word by Unicode's default boundaries: letters, digits and underscores, with what joins two letters or two digits.
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+(?:(?:(?<=[\p{L}\p{M}])['\u2019.:\u00b7\u2027](?=\p{L})|(?<=\p{N})[.,;'](?=\p{N}))[\p{L}\p{M}\p{N}_]+)*")


def positions(query: str) -> list[str | None]:
    """Up to MOST_WORDS words of a query; None stands for a word that is not of letters alone, and where more than blanks lies between two words."""
    out: list[str | None] = []
    text, end, words = unicodedata.normalize("NFC", query), None, 0
    for m in _WORD.finditer(text):
        if words == MOST_WORDS:
            break
        if end is not None and text[end : m.start()].strip():
            out.append(None)
        word = m[0]
        out.append(word.lower() if all(unicodedata.category(c)[0] in "LM" for c in word) else None)
        end, words = m.end(), words + 1
    return out


def candidates(query: str) -> dict[str, None]:
    """Every unit of up to MOST_UNIT_WORDS neighbouring words."""
    words, found = positions(query), {}
    for k in range(len(words)):
        for n in range(1, MOST_UNIT_WORDS + 1):
            unit = words[k : k + n]
            if len(unit) == n and None not in unit:
                found[" ".join(unit)] = None
    return found


def segmented(query: str, known: set[str]) -> list[str]:
    """Units from the left, the longest known one first, none over another; MOST_UNITS at most."""
    words, out, k = positions(query), [], 0
    while k < len(words) and len(out) < MOST_UNITS:
        for n in range(MOST_UNIT_WORDS, 0, -1):
            unit = words[k : k + n]
            if len(unit) == n and None not in unit and " ".join(unit) in known:
                out.append(" ".join(unit))
                k += n
                break
        else:
            k += 1
    return out


@dataclass(frozen=True)
class Plan:
    #: generated phrases with their ordinals, in turns over the units
    phrases: tuple[str, ...] = ()
    units: tuple[str, ...] = ()
    ambiguous: int = 0
    bypass: str | None = None


def plan(query: str, edges: DataFrame) -> Plan:
    """The phrases that a dictionary (unit, target) adds to a query.

    Quoted phrases and identifiers add none. A unit of over MOST_TARGETS targets is
    ambiguous: counted, not used. Targets come in turns: each unit's first, then each
    unit's second; of equal ones the first counts; MOST_PHRASES at most.
    """
    if quoted_phrase(query) is not None:
        return Plan(bypass="quoted")
    if is_identifier(query):
        return Plan(bypass="identifier")
    asked = list(candidates(query))
    if not asked:
        return Plan()
    near = edges.filter(F.col("unit").isin(*asked)).distinct()
    # a few hundred units at most are asked for, and of each one target more than may be used
    nth = near.withColumn("nth", F.row_number().over(Window.partitionBy("unit").orderBy("target"))).filter(F.col("nth") <= MOST_TARGETS + 1)
    targets: dict[str, list[str]] = {}
    for row in nth.orderBy("unit", "nth").collect():
        targets.setdefault(row.unit, []).append(row.target)
    units = segmented(query, set(targets))
    useful = [u for u in units if len(targets[u]) <= MOST_TARGETS]
    phrases = dict.fromkeys(targets[u][turn] for turn in range(MOST_TARGETS) for u in useful if turn < len(targets[u]))
    return Plan(tuple(phrases)[:MOST_PHRASES], tuple(units), len(units) - len(useful))


def phrase_hits(chunks: DataFrame, phrases: list[str]) -> DataFrame:
    """(chunk_id, page_id, score, evidence) of chunks whose title or text holds a phrase, once per phrase and field.

    The band of the field plus n / (1 + n) for n occurrences; evidence is generated, with the phrase's ordinal.
    """
    # one pass: the generator keeps a field's words in a column of their own, so that they are made once for all phrases
    words = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    fields = [F.struct(F.lit(field).alias("field"), F.lit(band).alias("band"), words(F.col(field)).alias("said")) for field, band in (("title", 2), ("text", 1))]
    each = chunks.select("chunk_id", "page_id", F.explode(F.array(*fields)).alias("_f"))

    def hit(ordinal: int, phrase: str) -> Column:
        inside = F.lit(" " + "  ".join(phrase.split()) + " ")
        n = (F.length("_f.said") - F.length(F.replace(F.col("_f.said"), inside, F.lit("")))) / F.length(inside)
        return F.when(F.contains("_f.said", inside), F.struct(F.lit(ordinal).alias("ordinal"), n.alias("n")))

    hits = F.filter(F.array(*[hit(k, p) for k, p in enumerate(phrases)]), lambda h: h.isNotNull())
    found = each.select("chunk_id", "page_id", "_f.field", "_f.band", F.explode(F.array(hits)).alias("_hits")).select("*", F.explode("_hits").alias("_h"))
    proof = F.struct(F.lit(True).alias("generated"), F.col("_h.ordinal").alias("ordinal"), F.col("field").alias("field"))
    return found.select("chunk_id", "page_id", F.round(F.col("band") + F.col("_h.n") / (1 + F.col("_h.n")), 6).alias("score"), proof.alias("evidence"))


def evidence(items: Column) -> Column:
    """Distinct evidence in order; more than MOST_EVIDENCE fails the query."""
    made = F.array_sort(F.array_distinct(items))
    return F.when(F.size(made) <= MOST_EVIDENCE, made).otherwise(F.raise_error(F.lit("a hit has too much evidence")).cast("array<struct<generated:boolean,ordinal:int,field:string>>"))


def merged(hits: DataFrame, limit: int) -> DataFrame:
    """One row per chunk: best score, evidence, whether the query itself met it, how many generated phrases did and the earliest of them; best first.

    Order: score, met by the query itself, fewer generated phrases, the earlier ordinal, page, chunk.
    """
    by = hits.groupBy("page_id", "chunk_id").agg(F.max("score").alias("score"), evidence(F.collect_set("evidence")).alias("evidence"))
    generated = F.filter("evidence", lambda e: e["generated"])
    by = by.select(
        "page_id",
        "chunk_id",
        "score",
        F.exists("evidence", lambda e: ~e["generated"]).alias("raw"),
        F.size(F.array_distinct(F.transform(generated, lambda e: e["ordinal"]))).cast("long").alias("generated"),
        F.array_min(F.transform(generated, lambda e: e["ordinal"])).cast("long").alias("earliest"),
        F.array_join(F.transform("evidence", lambda e: F.concat(F.when(e["generated"], F.concat(F.lit("g"), e["ordinal"].cast("string"))).otherwise("raw"), F.lit("/"), e["field"])), ",").alias("evidence"),
    )
    return by.orderBy(F.desc("score"), F.desc("raw"), "generated", F.asc_nulls_last("earliest"), "page_id", "chunk_id").limit(limit)
