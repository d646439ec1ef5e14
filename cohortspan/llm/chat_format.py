"""Chat formatting: conversations become marked-up text whose segments carry a loss flag.

A finite-state machine over roles says whether the turns come in a valid order. The template is
data: what stands before and after the text of each role, and whether that text is learned from.
DataFrame functions only; a conversation is one document and one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm.common import table
from cohortspan.llm.registry import query


@dataclass(frozen=True)
class Turn:
    """How the turns of a role are written."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, marks for any other role, and the machine that says which role may follow.

    ``moves`` maps a state to the roles it accepts; a role leads to the state of its own name.
    ``final`` are the states in which a conversation may end. The text of roles that ``turns`` does
    not name is written as ``other.before``, the escaped role, ``name_end``, the text, ``other.after``.
    """

    turns: dict[str, Turn]
    other: Turn
    name_end: str
    moves: dict[str, tuple[str, ...]]
    final: tuple[str, ...]
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = {m.strip() for t in (*self.turns.values(), self.other) for m in (t.before, t.after)}
        found = tuple(sorted(marks | {self.name_end}, key=lambda m: (-len(m), m)))
        if any(m[:1] not in "<[" or re.search(r"[<\[\\]", m[1:]) for m in found):
            raise ValueError("a control string starts with < or [ and holds neither again, nor a backslash")
        ends = [t.after for t in (*self.turns.values(), self.other)]
        if len(set(ends)) < len(ends):
            raise ValueError("each role needs an end mark of its own")
        object.__setattr__(self, "controls", found)


#: The production template.
TEMPLATE = Template(
    turns={
        "system": Turn("<SYS>", "</SYS>"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    other=Turn("[TURN]", "[/TURN]"),
    name_end="[TEXT]",
    moves={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
)


def _tails(template: Template) -> str:
    return "|".join(re.escape(m[1:]) for m in template.controls)


def escaped(text: Column, template: Template = TEMPLATE) -> Column:
    """A text without control strings: one backslash more behind the first character of each.

    A control string that already has backslashes there gets one more too, so ``unescaped`` undoes
    every text.
    """
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_tails(template)})", r"$1\\$2")


def unescaped(text: Column, template: Template = TEMPLATE) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={_tails(template)})", r"$1$2")


def turns_of(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its turns in order.

    Null texts and null roles count as empty. Turns without a number come first; turns with the same
    number are ordered by role and text, repeated rows stay. Rows without a conv_id are one
    conversation.
    """
    turn = F.struct(
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def final_state(turns: Column, template: Template = TEMPLATE) -> Column:
    """The state after all turns, or ``error`` once a role came that the state doesn't accept."""
    allowed = F.create_map(
        *[x for state, roles in template.moves.items() for x in (F.lit(state), F.array(*map(F.lit, roles)))]
    )

    def step(state: Column, turn: Column) -> Column:
        accepts = F.coalesce(F.array_contains(F.try_element_at(allowed, state), turn["role"]), F.lit(False))
        return F.when(accepts, turn["role"]).otherwise(F.lit("error"))

    return F.aggregate(turns, F.lit("start"), step)


def segments(turns: Column, template: Template = TEMPLATE) -> Column:
    """Marks and escaped texts in order, each with its loss flag; joined they are the formatted text."""

    def written(turn: Column) -> Column:
        other = template.other
        pieces = [(turn["role"] == role, t) for role, t in template.turns.items()]
        before = F.concat(F.lit(other.before), escaped(turn["role"], template), F.lit(template.name_end))
        after, loss = F.lit(other.after), F.lit(other.loss)
        for is_role, t in pieces:
            before = F.when(is_role, F.lit(t.before)).otherwise(before)
            after = F.when(is_role, F.lit(t.after)).otherwise(after)
            loss = F.when(is_role, F.lit(t.loss)).otherwise(loss)
        mark = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        body = F.struct(escaped(turn["text"], template).alias("text"), loss.alias("loss"))
        return F.array(mark(before), body, mark(after))

    return F.flatten(F.transform(turns, written))


def format_chats(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, segments (text, loss), valid: every conversation is formatted, ``valid`` says
    whether the machine accepts its turns."""
    return turns_of(conversations).select(
        "conv_id",
        segments(F.col("turns"), template).alias("segments"),
        F.array_contains(F.array(*map(F.lit, template.final)), final_state(F.col("turns"), template)).alias("valid"),
    )


def formatted_text(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: s["text"]), "")


def loss_text(of: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    learned = F.transform(F.filter(of, lambda s: s["loss"]), lambda s: unescaped(s["text"], template))
    return F.array_join(learned, "")


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns (role, text) that a formatted text holds, from its marks alone.

    Escaped texts hold no control string, so the text is cut behind each end mark; the end mark
    tells the role.
    """
    marks = [*template.turns.values(), template.other]
    ends = "|".join(re.escape(t.after) for t in marks)
    parts = F.filter(F.split(formatted, f"(?<={ends})", -1), lambda p: p != "")

    def turn(part: Column) -> Column:
        def cut(t: Turn) -> Column:
            size = F.length(part) - len(t.before) - len(t.after)
            return F.substring(part, F.lit(len(t.before) + 1), size)

        inner = cut(template.other)
        at = F.instr(inner, F.lit(template.name_end))
        role = F.substring(inner, F.lit(1), at - 1)
        text = F.substring(inner, at + len(template.name_end), F.length(inner))
        for name, t in template.turns.items():
            is_role = F.endswith(part, F.lit(t.after))
            role = F.when(is_role, F.lit(name)).otherwise(role)
            text = F.when(is_role, cut(t)).otherwise(text)
        return F.struct(unescaped(role, template).alias("role"), unescaped(text, template).alias("text"))

    return F.transform(parts, turn)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.sql(
        f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS (conv_id, turn, role, text)"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), written AS (
  SELECT *, regexp_replace(text, '([<\\[])(\\\\*)(/SYS>|SYS>|/INST\\]|INST\\]|/s>|s>|/TURN\\]|TURN\\]|TEXT\\])',
    '\\1\\\\\\2\\3', 'g') AS e,
    CASE coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), 'start')
      WHEN 'start' THEN role IN ('system', 'user') WHEN 'user' THEN role = 'assistant'
      WHEN 'system' THEN role = 'user' WHEN 'assistant' THEN role = 'user' ELSE false END AS accepted
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(e) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 11
    ELSE 19 + length(role) END) AS BIGINT) AS formatted_chars,
  bool_and(accepted) AND arg_max(role, turn) = 'assistant' AS valid
FROM written GROUP BY conv_id
"""


@query("op7_chat_format", SQL)
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_chats(with_probe(table(spark, sf_dir, "conversations")))
    text = made.select(
        "conv_id",
        formatted_text(F.col("segments")).alias("formatted"),
        loss_text(F.col("segments")).alias("learned"),
        "valid",
    )
    turns = text.select("conv_id", "formatted", "learned", "valid", read_back(F.col("formatted")).alias("turns"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
