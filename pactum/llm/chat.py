"""Chat formatting with DataFrame functions: a role machine, a template, loss flags.

A template is data: for each role the strings before and after its text, and
whether its text bears loss. Control strings that occur inside texts get an
ampersand after their first character (one more where some are there already),
which takes every control string out of the text and can be undone exactly. No
control string holds ``[`` or ``<`` but in front, so none can arise across a border.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, ERROR = "start", "error"


@dataclass(frozen=True)
class Template:
    #: role -> (before, after, loss)
    turns: dict = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)})
    #: How a turn of any other role is written: before the role, between, after the text.
    other: tuple = ("[ROLE]", "[|]", "[/ROLE]")
    #: state>role -> state; what is not listed is an error, and errors stay.
    moves: dict = field(default_factory=lambda: {"start>system": "system", "start>user": "user", "system>user": "user", "user>assistant": "assistant", "assistant>user": "user"})
    #: What follows the first character of a control string.
    tails: str = r"/?(?:INST|SYS|ROLE)\]|\|\]|/?s>"

    @property
    def pattern(self) -> str:
        """Matches one written turn."""
        q = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
        known = [f"{q(a)}.*?{q(b)}" for a, b, _ in self.turns.values()]
        return "(?s)" + "|".join([*known, f"{q(self.other[0])}.*?{q(self.other[2])}"])


def escape(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, rf"([\[<])(&*)({t.tails})", "$1&$2$3")


def unescape(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, rf"([\[<])&(&*)({t.tails})", "$1$2$3")


def _segments(role: Column, text: Column, t: Template) -> Column:
    """array<struct<text, loss>> of one turn."""
    part = lambda s, loss: F.struct(s.alias("text"), F.lit(loss).alias("loss"))
    a, b, c = map(F.lit, t.other)
    out = F.array(part(F.concat(a, escape(role, t), b), False), part(escape(text, t), False), part(c, False))
    for name, (before, after, loss) in t.turns.items():
        out = F.when(role == name, F.array(part(F.lit(before), False), part(escape(text, t), loss), part(F.lit(after), False))).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>, loss_spans, state: one row a conversation.

    ``loss_spans`` array<struct<start, length>>: what of ``formatted`` bears loss, counted in
    UTF-8 bytes, so that a span is cut out without a walk over the string.

    Turns go by ``turn``, then role, then text, so ties have one order and rows that
    repeat each count. Null role and null text are empty; a null conv_id is a
    conversation of its own. ``state`` is where the role machine ends, ``error`` once a
    turn is out of order; such conversations are written all the same. A conversation
    is one row in the end, so it must fit in a task; its turns are written before they
    meet. Extra columns are ignored.
    """
    t = template or Template()
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    written = rows.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), _segments(role, text, t).alias("s")).alias("x"))
    # The pieces that order a conversation and the pieces it writes travel together once.
    grouped = written.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    moves = F.create_map(*[F.lit(v) for kv in t.moves.items() for v in kv])
    step = lambda state, x: F.coalesce(F.element_at(moves, F.concat(state, F.lit(">"), x["role"])), F.lit(ERROR))
    laid = grouped.select("conv_id", F.flatten(F.transform("xs", lambda x: x["s"])).alias("segments"), F.aggregate("xs", F.lit(START), step).alias("state"))
    origin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def span(state: Column, s: Column) -> Column:
        size = F.octet_length(s["text"])
        new = F.array(F.struct(state["at"].alias("start"), size.alias("length")))
        return F.struct((state["at"] + size).alias("at"), F.when(s["loss"], F.concat(state["spans"], new)).otherwise(state["spans"]).alias("spans"))

    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return laid.select("conv_id", formatted.alias("formatted"), "segments", F.aggregate("segments", origin, span)["spans"].alias("loss_spans"), "state")


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """``formatted`` with ``turns`` array<struct<role, text>> parsed from the string alone."""
    t = template or Template()

    def parse(x: Column) -> Column:
        cut = lambda a, b: F.substring(x, F.lit(len(a) + 1), F.length(x) - len(a) - len(b))
        inner = cut(t.other[0], t.other[2])
        turn = lambda role, text: F.struct(role.alias("role"), unescape(text, t).alias("text"))
        at = F.instr(inner, t.other[1])
        out = turn(unescape(F.substring(inner, F.lit(1), at - 1), t), F.substring(inner, at + len(t.other[1]), F.length(inner)))
        for name, (before, after, _) in t.turns.items():
            out = F.when(F.startswith(x, F.lit(before)), turn(F.lit(name), cut(before, after))).otherwise(out)
        return out

    return formatted.withColumn("turns", F.transform(F.regexp_extract_all("formatted", F.lit(t.pattern), F.lit(0)), parse))


def digest(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """The digest columns of a formatted table, read back from ``formatted`` and ``loss_spans``."""
    t = template or Template()
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    cut = lambda s: F.substring(F.col("written"), s["start"] + 1, s["length"]).cast("string")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(cut(s), t)), "")
    formatted = formatted.withColumn("written", F.col("formatted").cast("binary"))
    return read_back(formatted, t).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "state", (F.col("state") != ERROR).alias("valid"),
    )
