"""Personal data: strict patterns, wide candidates and boosted trees, with DataFrame functions alone.

Strict patterns give the spans that always count (email, ip, card, phone). Wide generators
then propose further, overlapping spans in what is left: numbers that run into others,
other separators, spelled-out addresses. Format and context make up a few small features;
the strict spans are the positive examples, the other candidates the rest. One aggregation
counts how often each combination of features occurs with which label, over all documents;
gradient boosting needs no more than that table, whose size is bounded by the features'
bins (CELLS), not by the corpus. The trees come back as one Column expression. A threshold
per kind is set on a fold that the trees have not seen: the lowest score, even odds at
least, above which ``precision`` of the candidates are strict spans. No threshold, no added spans; and
none that fails its kind's own check.

Offsets count code points. They come from the text's split by the pattern: the pieces
between matches and the matches themselves, summed up. The patterns are written so that no
text takes quadratic time (possessive, never tried again inside a run they failed on), and
so that Java's matcher needs no recursion on long runs.

Defined results: null and empty texts have no spans; repeated rows and null doc_ids are rows
of their own; other columns are left out. Added spans overlap no strict span; of added
spans that overlap, the one with the higher score stays, of equal ones the earlier.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import saved

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
HOST = r"[A-Za-z0-9-]"
#: The strict patterns; possessive where giving back can't help, and not started inside a run.
STRICT = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without this have no strict span of the kind.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
_AT, _DOT = r"\x20?(?:@|[\[({]at[\])}])\x20?", r"(?:\x20?[\[({](?:dot|\.)[\])}]\x20?|\.)"
WIDE = (
    ("email", rf"(?<!{LOCAL}){LOCAL}++{_AT}{HOST}++(?:{_DOT}{HOST}++)++"),
    ("email", rf"(?<!{LOCAL}){LOCAL}++\x20at\x20{HOST}++(?:\x20dot\x20{HOST}++)++"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:(?:\x20?[\[(](?:dot|\.)[\])]\x20?|\.)[0-9]{1,3}){3}+(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){3}(?:[\x20.-]?[0-9]{1,3})?(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9+])\+?[0-9]{10,13}(?![0-9])"),
)
#: Words before a span that speak for its kind.
CUES = {
    "email": "mail|contact|write to|reach",
    "ip": "ip|host|server|addr|client|from",
    "card": "card|visa|master|amex|pay|credit|debit",
    "phone": "phone|tel|call|mobile|cell|fax|dial",
}
#: Last labels of an address that is spelled out in words.
TOP_LEVEL = "com|org|net|edu|gov|info|io|co|eu|de|fr|es|uk|us"
#: What stands in for a strict span when candidates are looked for; no pattern matches it.
FILL = "\ue000"
#: feature -> number of its bins
FEATURES = {"digits": 7, "space": 2, "dash": 2, "dot": 2, "paren": 2, "plus": 2, "sound": 2, "cue": 2, "secret": 2, "before": 3, "after": 3}
#: Most rows of the table of counts: kinds, labels, folds and all bins.
CELLS = len(KINDS) * 2 * 2 * int(np.prod(list(FEATURES.values())))
SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


@dataclass(frozen=True)
class Rule:
    rounds: int = 20
    rate: float = 0.3
    #: Share of strict spans among candidates above a threshold, on the fold held out.
    precision: float = 0.9
    #: One document in so many is held out of fitting, by crc32 of its doc_id.
    folds: int = 5
    #: Characters before a span that are read for cues.
    context: int = 32


def _located(values: Column, gaps: Column, context: int) -> Column:
    """Spans of matches: the pieces between them are added up, 256 at a time, so that long arrays are not copied for every match."""
    n = F.size(values)
    cut = F.zip_with(values, F.slice(gaps, F.lit(1), n), lambda v, g: F.struct(v.alias("v"), F.length(g).alias("skip"), F.right(g, F.lit(context)).alias("left")))
    cut = F.zip_with(cut, F.slice(gaps, F.lit(2), n), lambda c, g: F.struct(c["v"].alias("v"), c["skip"].alias("skip"), c["left"].alias("left"), F.left(g, F.lit(2)).alias("right")))
    none = F.array().cast(SPAN)

    def one(acc: Column, c: Column) -> Column:
        start = acc["at"] + c["skip"]
        end = start + F.length(c["v"])
        span = F.struct(start.alias("start"), end.alias("end"), c["v"].alias("value"), c["left"].alias("left"), c["right"].alias("right"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def some(acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(acc["cut"], k * 256 + 1, F.lit(256)), F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return F.struct(part["at"].alias("at"), F.concat(acc["out"], part["out"]).alias("out"), acc["cut"].alias("cut"))

    # the pieces travel with the sum: named outside, they would be made anew for every 256
    many = F.sequence(F.lit(0), F.floor((n - 1) / 256).cast("int"))
    return F.when(n > 0, F.aggregate(many, F.struct(F.lit(0).alias("at"), none.alias("out"), cut.alias("cut")), some)["out"]).otherwise(none)


def find(df: DataFrame, text: str, pattern: str, out: str, context: int, needs: Column | None = None) -> DataFrame:
    """df with the array ``out`` of all matches in a text column, and their pieces in ``out``_gaps (null where nothing matches)."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn("_v", values if needs is None else F.when(needs, values).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(f"{out}_gaps", F.when(F.size("_v") > 0, F.split(text, pattern, -1)))
    return df.withColumn(out, F.when(F.size("_v") > 0, _located(F.col("_v"), F.col(f"{out}_gaps"), context)).otherwise(F.array().cast(SPAN))).drop("_v")


def luhn(digits: Column) -> Column:
    """Whether up to 20 digits pass the check sum."""
    each = F.split(F.lpad(digits, 20, "0"), "")
    total = F.aggregate(F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int"))), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def sound(kind: str, value: Column) -> Column:
    """Whether a match of a strict pattern counts."""
    n = F.length(digits_of(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits_of(value))).otherwise(False)
    return n.between(8, 15)


def plausible(kind: str, value: Column, plain: Column) -> Column:
    """The same for a candidate, whatever its separators; an address in words must end like one."""
    if kind == "email":
        words = F.contains(value, F.lit(" at "))
        return F.rlike(plain, F.lit(r"\.[A-Za-z]{2,10}$")) & (~words | F.rlike(plain, F.lit(rf"(?i)\.(?:{TOP_LEVEL})$")))
    if kind == "ip":
        return sound("ip", F.regexp_replace(value, "[^0-9]+", "."))
    return sound(kind, value)


def features(kind: str, s: Column) -> Column:
    """A span's kind and features as one struct of small integers."""
    value, left, right = s["value"], s["left"], s["right"]
    n = F.length(digits_of(value))
    bins = sum((F.when(n >= at, 1).otherwise(0) for at in (8, 10, 11, 13, 16, 17)), F.lit(0))
    has = lambda p: F.when(F.rlike(value, F.lit(p)), 1).otherwise(0)
    # spelled-out connectors are read as what they stand for
    plain = value if kind not in ("email", "ip") else F.regexp_replace(F.regexp_replace(value, r"\x20?[\[({]at[\])}]\x20?|\x20at\x20", "@"), r"\x20?[\[({](?:dot|\.)[\])}]\x20?|\x20dot\x20", ".")
    beside = lambda c: F.when(c == "", 0).when(F.rlike(c, F.lit(r"^\s$")), 0).when(F.rlike(c, F.lit(r"^[\p{L}\p{N}_]$")), 2).otherwise(1)
    made = {
        "digits": bins,
        "space": F.when(F.contains(plain, F.lit(" ")), 1).otherwise(0),
        "dash": has("-"),
        "dot": F.when(F.contains(plain, F.lit(".")), 1).otherwise(0),
        "paren": has(r"\([0-9]"),
        "plus": has(r"^\+"),
        "sound": F.when(plausible(kind, value, plain), 1).otherwise(0),
        "cue": F.when(F.rlike(left, F.lit(rf"(?i)\b(?:{CUES[kind]})")), 1).otherwise(0),
        "secret": F.when(F.rlike(left, F.lit(r"(?i)(?:token|secret|key|hash|id|sha)\b[^\p{L}]*$|[=\"'][^\s]*$")), 1).otherwise(0),
        "before": beside(F.right(left, F.lit(1))),
        "after": beside(F.left(right, F.lit(1))),
    }
    return F.struct(*[made[f].cast("int").alias(f) for f in FEATURES])


def _sound(kind: str, s: Column) -> Column:
    return sound(kind, s["value"])


def _hidden(kind: str, gap: Column, s: Column) -> Column:
    """A piece of the text and the match after it, a strict span as so many FILL."""
    fill = F.repeat(F.lit(FILL), s["end"] - s["start"])
    return F.concat(gap, F.when(s.isNull(), "").when(sound(kind, s["value"]), fill).otherwise(s["value"]))


def _row(kind: int, s: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), features(KINDS[kind], s).alias("features"))


def candidates(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, strict, wide) of every row: arrays of struct<kind, start, end, features>; kinds are numbered as in KINDS."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("left_over", F.col("text"))
    digits = F.rlike("text", F.lit("[0-9]"))
    for k, kind in enumerate(KINDS):
        needs = F.contains("text", F.lit(NEEDED[kind])) if kind in NEEDED else F.lit(True)
        df = find(df, "text", STRICT[kind], "found", rule.context, needs if kind == "email" else needs & digits)
        df = df.withColumn(kind, F.filter("found", partial(_sound, kind))).drop("found", "found_gaps")
    some = sum((F.size(kind) for kind in KINDS), F.lit(0)) > 0
    for kind in KINDS:
        df = find(df, "left_over", STRICT[kind], "again", 0, some & (F.size(kind) > 0))
        shown = F.zip_with("again_gaps", "again", partial(_hidden, kind))
        df = df.withColumn("left_over", F.when(F.size("again") > 0, F.array_join(shown, "")).otherwise(F.col("left_over"))).drop("again", "again_gaps")
    none = F.array().cast(f"array<struct<kind:int,start:int,end:int,features:struct<{','.join(f'{f}:int' for f in FEATURES)}>>>")
    df = df.withColumn("strict", F.concat(none, *[F.transform(kind, partial(_row, k)) for k, kind in enumerate(KINDS)])).drop(*KINDS)
    at = F.rlike("left_over", F.lit(r"@|[\[({]at[\])}]|\x20dot\x20"))
    for i, (kind, pattern) in enumerate(WIDE):
        df = find(df, "left_over", pattern, "found", rule.context, at if kind == "email" else digits).withColumn(f"wide{i}", F.transform("found", partial(_row, KINDS.index(kind)))).drop("found", "found_gaps")
    return df.select("doc_id", "strict", F.concat(none, *[f"wide{i}" for i in range(len(WIDE))]).alias("wide"))


def counts(found: DataFrame, rule: Rule) -> DataFrame:
    """(kind, label, held, features, n): how often each combination occurs; at most CELLS rows whatever the corpus."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % rule.folds == 0, F.lit(False))
    labelled = lambda name, label: F.transform(name, lambda s: F.struct(s["kind"].alias("kind"), F.lit(label).alias("label"), s["features"].alias("f")))
    rows = found.select(held.alias("held"), F.explode(F.concat(labelled("strict", 1), labelled("wide", 0))).alias("s"))
    return rows.groupBy("s.kind", "s.label", "held", *[F.col(f"s.f.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n"))


#: A tree: (feature, bin), then the values (or None) and second splits below and above it.
Tree = tuple


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[float, int, int]:
    """The best (gain, feature, bin) of splitting rows at x <= bin; second-order gains with one unit of shrinkage."""
    value = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = (1e-9, -1, 0)
    for j in range(x.shape[1]):
        for at in range(int(x[rows, j].max(initial=0))):
            low = rows & (x[:, j] <= at)
            gain = value(low) + value(rows & ~low) - value(rows)
            if gain > best[0]:
                best = (gain, j, at)
    return best


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, rule: Rule) -> list[Tree]:
    """Boosted trees of two levels for the log-odds of label 1, over combinations x that occur n times."""
    score, trees = np.zeros(len(x)), []
    for _ in range(rule.rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = n * (y - p), n * p * (1 - p)
        leaf = lambda m: float(rule.rate * g[m].sum() / (h[m].sum() + 1))
        everything = np.ones(len(x), bool)
        _, j, at = _split(x, g, h, everything)
        if j < 0:
            value = leaf(everything)
            trees.append((value,))
            score += value
            continue
        sides = []
        for side in (x[:, j] <= at, x[:, j] > at):
            _, i, cut = _split(x, g, h, side)
            if i < 0:
                value = leaf(side)
                sides.append((value,))
                score[side] += value
                continue
            low, high = side & (x[:, i] <= cut), side & (x[:, i] > cut)
            values = leaf(low), leaf(high)
            sides.append((i, cut, *values))
            score[low] += values[0]
            score[high] += values[1]
        trees.append((j, at, *sides))
    return trees


def scored(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    def side(t: Tree, x: np.ndarray) -> np.ndarray:
        if len(t) == 1:
            return np.full(len(x), t[0])
        low, high = (v if isinstance(v, tuple) else (v,) for v in t[2:])
        return np.where(x[:, t[0]] <= t[1], side(low, x), side(high, x))

    return sum((side(t, x) for t in trees), np.zeros(len(x)))


def expression(trees: list[Tree], f: Column) -> Column:
    """The trees' sum as a Column over a features struct."""
    names = list(FEATURES)

    def side(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(t)
        if len(t) == 1:
            return F.lit(t[0])
        return F.when(f[names[t[0]]] <= t[1], side(t[2])).otherwise(side(t[3]))

    return sum((side(t) for t in trees), F.lit(0.0))


@dataclass(frozen=True)
class Model:
    trees: dict[int, list[Tree]]
    #: kind -> lowest score that is taken; kinds without one add nothing
    thresholds: dict[int, float]


def threshold(score: np.ndarray, y: np.ndarray, n: np.ndarray, precision: float) -> float | None:
    """The lowest score of even odds or better above which the share of label 1 is high enough."""
    order = np.argsort(-score, kind="stable")
    ends = np.flatnonzero(np.r_[np.diff(score[order]) != 0, True]) if len(score) else np.zeros(0, int)
    hit, every = np.cumsum((n * y)[order])[ends], np.cumsum(n[order])[ends]
    good = np.flatnonzero((hit >= precision * every) & (hit > 0) & (score[order][ends] >= 0))
    return float(score[order][ends[good[-1]]]) if len(good) else None


def train(cells: DataFrame, rule: Rule) -> Model:
    """Trees from the documents that are not held out, thresholds from those that are (from all where none of a kind is)."""
    rows = cells.collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], np.int64).reshape(len(rows), len(FEATURES))
    kind, y, held, n = (np.array([r[c] for r in rows], np.int64) for c in ("kind", "label", "held", "n"))
    trees, cuts = {}, {}
    for k in range(len(KINDS)):
        mine = kind == k
        learn, test = mine & (held == 0), mine & (held == 1)
        if not (y[learn] == 1).any():
            continue
        # combinations in a fixed order, so that sums and ties come out alike in every run
        order = np.lexsort([*x[learn].T, y[learn]])
        trees[k] = fit(x[learn][order], y[learn][order], n[learn][order].astype(float), rule)
        use = test if (y[test] == 1).any() else mine
        cut = threshold(scored(trees[k], x[use]), y[use], n[use], rule.precision)
        if cut is not None:
            cuts[k] = cut
    return Model(trees, cuts)


def selected(found: DataFrame, model: Model) -> DataFrame:
    """found with ``added``: array<struct<start, end, kind, score>> of the candidates over their thresholds, none of which overlap."""
    def judge(s: Column) -> Column:
        made = F.lit(None).cast("double")
        for k, cut in model.thresholds.items():
            value = expression(model.trees[k], s["features"])
            # the sum is rounded alike on both sides of the comparison
            made = F.when((s["kind"] == k) & (s["features"]["sound"] == 1) & (F.round(value, 9) >= round(cut, 9)), value).otherwise(made)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), made.alias("score"))

    taken = F.array_sort(F.filter(F.transform("wide", judge), lambda s: s["score"].isNotNull()))
    none = F.array().cast("array<struct<start:int,end:int,kind:int,score:double>>")

    def clear(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        apart = (F.size(acc) == 0) | (last["end"] <= s["start"])
        return F.when(apart, F.concat(acc, F.array(s))).when(s["score"] > last["score"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(s))).otherwise(acc)

    made = found.withColumn("_taken", taken)
    return made.withColumn("added", F.when(F.size("_taken") > 1, F.aggregate("_taken", none, clear)).otherwise(F.col("_taken"))).drop("_taken")


def detect(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """(doc_id, strict, wide, added) of every row, the model fitted on these documents."""
    rule = rule or Rule()
    found = saved(candidates(docs, rule), "spans")
    return selected(found, train(counts(found, rule), rule))


def span_digest(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """Per document: the strict spans by kind, their digest, and all spans."""
    made = detect(docs, rule)
    flat = lambda name: F.transform(name, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("strict", lambda s: s["kind"] == k)).cast("long")
    return made.select(
        "doc_id",
        *[number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(said(flat("strict")), 256).alias("base_sha256"),
        said(F.concat(flat("strict"), flat("added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
