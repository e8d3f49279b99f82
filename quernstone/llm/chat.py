"""Chat formatting with DataFrame functions only.

A conversation's turns run through a finite-state machine over roles; a declarative template
turns them into segments, each with a loss flag.  Control strings inside texts are escaped so
that the markers of the formatted text are the template's own, and the text reads back exactly.

Escape: in texts and roles, the first character of the template's guard (``<|``) and the backslashes after it, if followed by
the rest of the guard, get one more backslash (``<|`` becomes ``<\\|``).  Role names also have backslashes, line feeds and
carriage returns written as two characters.

Defined results: turns stand by (turn, role, text), nulls first, so ties and repeated rows keep a
fixed order; null texts and roles are empty; a null conv_id is a conversation like any other;
conversations whose roles the machine refuses are formatted as they are, with ``valid`` false; only
roles the template names carry loss; an empty table gives an empty result; other columns are not
read.  A conversation is one row by its nature, so its text has to fit a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Markers around a turn, the roles whose text carries loss, and the machine that checks order."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    between: str = "\n"
    #: What both marks begin with; texts are escaped where they hold it.
    guard: str = "<|"
    loss_roles: tuple[str, ...] = ("assistant",)
    first: str = "begin"
    #: (state, role) to the next state; whatever is missing is refused.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "told", ("begin", "user"): "asked", ("told", "user"): "asked",
            ("asked", "assistant"): "answered", ("answered", "user"): "asked",
        }
    )
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        if len(self.guard) < 2 or "\\" in self.guard or self.guard[0] in self.guard[1:] or not (self.start.startswith(self.guard) and self.end.startswith(self.guard)):
            raise ValueError("both marks must begin with the guard, of two characters or more, without a backslash, the first of them once")
        if "\\" in self.after_role or not self.after_role.startswith("\n"):
            raise ValueError("a role ends at a line end, which is what is escaped in it")


CHATML = ChatTemplate()
REFUSED = "refused"


def escaped(text: Column, template: ChatTemplate = CHATML) -> Column:
    """One more backslash after the guard's first character wherever the rest of the guard follows, after backslashes or none."""
    head, rest = template.guard[0], template.guard[1:]
    return F.regexp_replace(text, rf"\Q{head}\E(\\*)\Q{rest}\E", _plain(head) + r"\\$1" + _plain(rest))


def unescaped(text: Column, template: ChatTemplate = CHATML) -> Column:
    head, rest = template.guard[0], template.guard[1:]
    return F.regexp_replace(text, rf"\Q{head}\E\\(\\*)\Q{rest}\E", _plain(head) + "$1" + _plain(rest))


def _plain(text: str) -> str:
    """Text as it stands in a replacement."""
    return text.replace("$", r"\$")


def escaped_role(role: Column, template: ChatTemplate = CHATML) -> Column:
    one_line = F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return escaped(one_line, template)


def unescaped_role(role: Column, template: ChatTemplate = CHATML) -> Column:
    """Read pairs from the left: a backslash and the character after it."""
    role = unescaped(role, template)
    parts = F.split(role, r"\\\\", -1)  # between doubled backslashes
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(plain, "\\")


def final_state(roles: Column, template: ChatTemplate) -> Column:
    """State after all roles."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    return F.aggregate(roles, F.lit(template.first), lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit(REFUSED)))


def formatted(conversations: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """conv_id, valid, segments array<struct<text, loss>> and formatted: one row per conversation."""
    t = template
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    of_turn = lambda x: F.array(
        segment(F.concat(F.lit(t.start), escaped_role(x["role"], t), F.lit(t.after_role)), F.lit(False)),
        segment(escaped(x["text"], t), x["role"].isin(*t.loss_roles)),
        segment(F.lit(t.end + t.between), F.lit(False)),
    )
    rows = rows.select(
        "conv_id",
        final_state(F.transform("turns", lambda x: x["role"]), t).isin(*t.final).alias("valid"),
        F.flatten(F.transform("turns", of_turn)).alias("segments"),
    )
    return rows.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted_text: Column, template: ChatTemplate = CHATML) -> Column:
    """array<struct<role, text>> from a formatted conversation."""
    t = template
    turns = F.split(formatted_text, rf"\Q{t.start}\E", -1)
    turns = F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0)))
    role_end = lambda x: F.instr(x, t.after_role)
    role = lambda x: F.substr(x, F.lit(1), role_end(x) - 1)
    tail = len(t.end + t.between)
    text = lambda x: F.substr(x, role_end(x) + len(t.after_role), F.length(x) - role_end(x) - len(t.after_role) + 1 - tail)
    return F.transform(turns, lambda x: F.struct(unescaped_role(role(x), t).alias("role"), unescaped(text(x), t).alias("text")))


def loss_text(segments: Column, template: ChatTemplate = CHATML) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
