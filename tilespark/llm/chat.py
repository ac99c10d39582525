"""Chat formatting by a declarative template, with DataFrame operations only.

A template gives, for each role, the marks before and after a turn's text and
whether the text is under the loss mask. A finite-state machine over the roles
says whether the turn order is valid. The output of a conversation is an array
of segments (text, loss): for each turn its opening mark, its escaped text and
its closing mark; the loss flag stands on texts alone, so marks are never
learnt. All characters that could begin a mark are escaped, so no mark can
appear in a text and the output can be read back exactly.

Defined cases: a null text is empty; turns are ordered by turn, role, text
(null first); repeated rows are turns of their own; a null or unknown role is
written with a general mark that carries its name (null as the empty name),
makes the order invalid, and has no loss; conversations of a null conv_id form
one conversation. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """The marks of a role: `opens` and `closes` begin and end with the only characters that texts lose by escaping."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    roles: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", loss=True)})
    other_opens: str = "<<ROLE:"
    other_ends: str = ">>"
    other_closes: str = "<</ROLE>>"
    #: Each character that begins a mark, or ends a role's name, and what stands for it in a text; the escape character first.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("<", "\\l"), ("[", "\\i"), (">", "\\g"))
    #: State -> role -> next state; a conversation is valid if it ends in one of `final`.
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: tuple[str, ...] = ("assistant",)


def escape(text: Column, template: ChatTemplate) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), template.escapes, text)


def unescape(text: Column, template: ChatTemplate) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[1]), F.lit(pair[0])), reversed(template.escapes), text)


def _choose(role: Column, template: ChatTemplate, pick, other: Column) -> Column:
    out = None
    for name, turn in template.roles.items():
        out = (F.when if out is None else out.when)(role == name, F.lit(pick(turn)))
    return out.otherwise(other)


def final_state(roles: Column, template: ChatTemplate) -> Column:
    """The state after all roles, or 'invalid' once there is no move."""

    def step(state: Column, role: Column) -> Column:
        out = F.when(role.isNull(), F.lit("invalid"))
        for at, moves in template.moves.items():
            for name, to in moves.items():
                out = out.when((state == at) & (role == name), F.lit(to))
        return out.otherwise(F.lit("invalid"))

    return F.aggregate(roles, F.lit("start"), step)


def format_chats(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """A row per conversation: conv_id, valid, segments array<struct<text, loss>>."""
    template = template or ChatTemplate()
    rows = turns.select("conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        name = F.coalesce(t["role"], F.lit(""))
        opens = _choose(name, template, lambda x: x.opens, F.concat(F.lit(template.other_opens), escape(name, template), F.lit(template.other_ends)))
        closes = _choose(name, template, lambda x: x.closes, F.lit(template.other_closes))
        loss = _choose(name, template, lambda x: x.loss, F.lit(False))
        piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
        return F.array(piece(opens, F.lit(False)), piece(escape(t["text"], template), loss), piece(closes, F.lit(False)))

    valid = final_state(F.transform("turns", lambda t: t["role"]), template).isin(*template.final)
    return chats.select("conv_id", valid.alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column, template: ChatTemplate | None = None) -> Column:
    """array<struct<role, text>> from one formatted text."""
    template = template or ChatTemplate()
    quote = lambda x: "".join("\\" + c if c in "[](){}<>/\\^$.|?*+-" else c for c in x)
    body = "[^<\\[]*"
    opens = "|".join([*(quote(t.opens) for t in template.roles.values()), quote(template.other_opens) + "[^<\\[>]*" + quote(template.other_ends)])
    closes = "|".join([*(quote(t.closes) for t in template.roles.values()), quote(template.other_closes)])
    pattern = F.lit(f"({opens})({body})(?:{closes})")
    marks, texts = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))

    def role(mark: Column) -> Column:
        head, tail = len(template.other_opens), len(template.other_opens) + len(template.other_ends)
        out = None
        for name, turn in template.roles.items():
            out = (F.when if out is None else out.when)(mark == turn.opens, F.lit(name))
        return out.otherwise(unescape(F.substr(mark, F.lit(head + 1), F.greatest(F.length(mark) - tail, F.lit(0))), template))

    return F.zip_with(marks, texts, lambda m, t: F.struct(role(m).alias("role"), unescape(t, template).alias("text")))


def chat_digest(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Digests that are read back from the formatted output: its text and its loss mask."""
    template = template or ChatTemplate()
    out = format_chats(turns, template)
    read = out.select(
        "conv_id",
        "valid",
        formatted(F.col("segments")).alias("text"),
        formatted(F.filter("segments", lambda s: s["loss"])).alias("loss"),
    )
    read = read.select("conv_id", "valid", "text", unescape(F.col("loss"), template).alias("loss"), read_turns(F.col("text"), template).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
        "valid",
    )
