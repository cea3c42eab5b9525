"""Chat formatting with DataFrame functions only.

A declarative template gives each role its marker and loss flag; a finite
state machine over roles checks the turn order.  Each conversation becomes a
list of text segments with a loss flag each.  Control characters inside texts
are escaped, so the formatted string can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = {"system": {"open": "### System: ", "loss": False}, "user": {"open": "### User: ", "loss": False}, "assistant": {"open": "### Assistant: ", "loss": True}}
OTHER_OPEN = "### ="  # before the escaped name of a role that the template lacks
CLOSE = "</turn>\n"
#: state, role -> next state; anything else is an error that stays.
TRANSITIONS = {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
ACCEPTING = ("assistant",)

# Escapes, in the order they are written; read back in reverse order.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c")]


def escape(c: F.Column, role: bool = False) -> F.Column:
    for plain, code in ESCAPES if role else ESCAPES[:3]:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: F.Column, role: bool = False) -> F.Column:
    for plain, code in reversed(ESCAPES if role else ESCAPES[:3]):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _by_role(template: dict, role: F.Column, key: str, other) -> F.Column:
    out = F.lit(other) if not isinstance(other, F.Column) else other
    for name, spec in template.items():
        out = F.when(role == name, F.lit(spec[key])).otherwise(out)
    return out


def format_conversations(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: dict = TEMPLATE, transitions: dict = TRANSITIONS, accepting: tuple = ACCEPTING) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, segments
    (array of text, loss), formatted.

    Turns go by turn number, ties by role and text; repeated rows are turns
    of their own.  Null text or role is empty, a null turn comes first, rows
    with a null conv_id are one conversation.  A role outside the template is
    formatted without loss and makes the conversation invalid; invalid ones
    are formatted all the same.  No rows give no conversations.
    """
    rows = turns.select(F.col(conv_id).alias("id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    step = F.create_map(*[x for (state, name), to in transitions.items() for x in (F.lit(f"{state}|{name}"), F.lit(to))])
    state = F.aggregate("turns", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(step, F.concat(s, F.lit("|"), t["role"])), F.lit("error")))

    def pieces(t):
        named = F.concat(F.lit(OTHER_OPEN), escape(t["role"], role=True), F.lit(": "))
        opened, loss = _by_role(template, t["role"], "open", named), _by_role(template, t["role"], "loss", False)
        return F.array(F.struct(opened.alias("text"), F.lit(False).alias("loss")), F.struct(escape(t["text"]).alias("text"), loss.alias("loss")), F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))

    out = grouped.select("id", F.size("turns").cast("long").alias("n_turns"), state.isin(*accepting).alias("valid"), F.flatten(F.transform("turns", pieces)).alias("segments"))
    return out.select(F.col("id").alias(conv_id), "n_turns", "valid", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: F.Column, template: dict = TEMPLATE) -> F.Column:
    """array of (role, text), read back from a formatted string."""
    parts = F.split(formatted, "</turn>\n")

    def one(p):
        role = None
        named = p.startswith(OTHER_OPEN)
        at = F.instr(p, ": ")
        for name, spec in template.items():
            hit = p.startswith(spec["open"])
            role = F.when(hit, F.lit(name)) if role is None else role.when(hit, F.lit(name))
        role = F.when(named, unescape(F.substring(p, F.lit(len(OTHER_OPEN) + 1), at - F.lit(len(OTHER_OPEN) + 1)), role=True)).otherwise(role)
        return F.struct(role.alias("role"), unescape(F.substring(p, at + F.lit(2), F.length(p))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - F.lit(1)), one)


def loss_text(segments: F.Column) -> F.Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
