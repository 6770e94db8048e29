"""Chat formatting with DataFrame functions alone.

A Template states, as data, the markers of a turn, which role may follow which, and which
roles' texts a model learns from. format_conversations() runs its finite-state machine
over the turns of each conversation and emits text segments with a loss flag each;
parse_formatted() reads turns back from the joined text.

Texts can hold any marker: within a text every ``<``, some backslashes, ``|`` gets one
backslash more, which leaves no ``<|`` and can be undone. In a role ``%``, ``<`` and line
feeds are percent-encoded.

Defined results: a null role or text is empty; rows of equal conv_id and turn go by role,
then text, null turns first; repeated rows are turns of their own; a null conv_id is one
conversation. A conversation that breaks the turn order is still formatted; ``valid`` is
false and ``rejected_at`` is the position of the first turn that broke it (for a missing
last answer: the number of turns). A conversation becomes one value, so one must fit in
a task; rows of different conversations never meet.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    turn_open: str = "<|im_start|>"
    head_close: str = "\n"
    turn_close: str = "<|im_end|>\n"
    #: state -> {role that may come next: the state that it leads to}
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered", "tool": "asked"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )
    start: str = "start"
    accepting: tuple = ("answered",)
    loss_roles: tuple = ("assistant",)


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def _moves(template: Template) -> Column:
    """Map of 'state, line feed, role' to the next state."""
    pairs = [F.lit(x) for state, to in template.moves.items() for role, then in to.items() for x in (f"{state}\n{role}", then)]
    return F.create_map(*pairs)


def format_conversations(df: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, valid, rejected_at, segments array<struct<role, text, loss>>, formatted)."""
    template = template or Template()
    moves = _moves(template)
    turns = df.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def move(acc: Column, t: Column) -> Column:
        then = F.try_element_at(moves, F.concat(acc["state"], F.lit("\n"), t["role"]))
        return F.struct(
            F.when(acc["bad"].isNull(), F.coalesce(then, acc["state"])).otherwise(acc["state"]).alias("state"),
            F.when(acc["bad"].isNull() & then.isNull(), acc["at"]).otherwise(acc["bad"]).alias("bad"),
            (acc["at"] + 1).alias("at"),
        )

    run = F.aggregate("turns", F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("at")), move)

    def segment(role: Column, text: Column, loss: Column) -> Column:
        return F.struct(role.alias("role"), text.alias("text"), loss.alias("loss"))

    def emit(t: Column) -> Column:
        role, no = t["role"], F.lit(False)
        head = F.concat(F.lit(template.turn_open), escape_role(role), F.lit(template.head_close))
        return F.array(segment(role, head, no), segment(role, escape_text(t["text"]), role.isin(*template.loss_roles)), segment(role, F.lit(template.turn_close), no))

    made = grouped.select("conv_id", run.alias("run"), F.flatten(F.transform("turns", emit)).alias("segments"))
    rejected = F.coalesce(F.col("run.bad"), F.when(~F.col("run.state").isin(*template.accepting), F.col("run.at")))
    return made.select(
        "conv_id",
        rejected.isNull().alias("valid"),
        rejected.alias("rejected_at"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def parse_formatted(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    template = template or Template()
    turns = F.split(formatted, r"\Q" + template.turn_open + r"\E", -1)

    def turn(t: Column) -> Column:
        at = F.instr(t, template.head_close)
        body = F.substr(t, at + F.lit(len(template.head_close)))
        return F.struct(
            unescape_role(F.substr(t, F.lit(1), at - 1)).alias("role"),
            unescape_text(F.substr(body, F.lit(1), F.length(body) - len(template.turn_close))).alias("text"),
        )

    return F.transform(F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0))), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape_text(s["text"])), "")


def format_digest(df: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation: digests of the turns and the learned text, both read back from the output."""
    made = format_conversations(df, template).withColumn("read", parse_formatted(F.col("formatted"), template)).withColumn("learned", loss_text(F.col("segments")))
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("rejected_at").cast("long").alias("rejected_at"),
    )
