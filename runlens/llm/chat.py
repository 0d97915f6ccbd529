"""Chat formatting: records of different layouts become turns, turns become one marked text.

A layout is known by its nested field paths. For every record the paths that hold something are
listed and hashed; the hash selects one of the declared mappings below, which says where the
turns are. So prompt, instruction and message records may stand in one table (its schema being
the union of theirs), and further fields change nothing: only paths that some mapping names count.

The template writes each turn as ``<turn>role LF text</turn> LF``. A backslash inside a role or a
text is doubled and a mark gets a backslash behind its first character, so marks stand nowhere but
around turns and everything can be read back. All of it is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

OPEN, CLOSE = "<turn>", "</turn>"
TURNS = "array<struct<role:string,text:string>>"
#: Other names of the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class One:
    """One turn; its text is the fields that are there, with an empty line between them."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for every element of an array, from its role and text fields."""

    array: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    """Where the turns of a layout are. ``needs`` are its paths, ``may`` those it can have besides."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: tuple[One | Each, ...]

    def fingerprints(self) -> list[str]:
        """Hashes of every set of paths that the layout covers."""
        sets = [self.needs + more for k in range(len(self.may) + 1) for more in combinations(self.may, k)]
        return [hashlib.sha256("\n".join(sorted(s)).encode()).hexdigest() for s in sets]


LAYOUTS = (
    Layout("messages", ("messages[].role",), ("messages[].content",), (Each("messages", "role", "content"),)),
    Layout("message_texts", ("messages[].role", "messages[].text"), (), (Each("messages", "role", "text"),)),
    Layout("from_value", ("conversations[].from",), ("conversations[].value", "system"),
           (One("system", ("system",)), Each("conversations", "from", "value"))),
    Layout("nested_messages", ("conversation.messages[].role",), ("conversation.messages[].content",),
           (Each("conversation.messages", "role", "content"),)),
    Layout("prompt_completion", ("prompt", "completion"), ("system",),
           (One("system", ("system",)), One("user", ("prompt",)), One("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",),
           (One("system", ("system",)), One("user", ("prompt",)), One("assistant", ("response",)))),
    Layout("prompt_messages", ("prompt[].role", "completion[].role"), ("prompt[].content", "completion[].content"),
           (Each("prompt", "role", "content"), Each("completion", "role", "content"))),
    Layout("question_answer", ("question", "answer"), ("system",),
           (One("system", ("system",)), One("user", ("question",)), One("assistant", ("answer",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"),
           (One("system", ("system",)), One("user", ("instruction", "input")), One("assistant", ("output",)))),
)


def field_paths(kind: DataType, prefix: str = "") -> list[str]:
    """Paths of all leaves of a schema: ``a.b`` inside structs, ``[]`` behind arrays."""
    if isinstance(kind, StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    return [prefix]


def _holds(value: Column, steps: Sequence[str]) -> Column:
    """Whether something lies at the end of the steps, in any element of the arrays on the way."""
    if not steps:
        return value.isNotNull()
    if steps[0] == "[]":
        return F.coalesce(F.exists(value, lambda x: _holds(x, steps[1:])), F.lit(False))
    return _holds(value.getField(steps[0]), steps[1:])


def _steps(path: str) -> list[str]:
    return [s for s in path.replace("[]", ".[]").split(".") if s]


def _quoted(path: str) -> Column:
    return F.col(".".join(f"`{step}`" for step in path.split(".")))


def fingerprint(schema: StructType, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """SHA-256 of the sorted paths that hold something in a record, out of those the layouts name."""
    named = {p for layout in layouts for p in layout.needs + layout.may}
    found = []
    for path in sorted(named & set(field_paths(schema))):
        first, *rest = _steps(path)
        found.append(F.when(_holds(F.col(f"`{first}`"), rest), F.lit(path)))
    return F.sha2(F.concat_ws("\n", *found) if found else F.lit(""), 256)


def _turns(layout: Layout, paths: set[str]) -> Column:
    parts = []
    for rule in layout.turns:
        if isinstance(rule, One):
            texts = [_quoted(f) for f in rule.fields if f in paths]
            if texts:
                text = F.concat_ws("\n\n", *texts)
                turn = F.array(F.struct(F.lit(rule.role).alias("role"), text.alias("text"))).cast(TURNS)
                parts.append(F.when(F.coalesce(*texts).isNotNull(), turn).otherwise(F.array().cast(TURNS)))
        else:
            names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
            has_text = f"{rule.array}[].{rule.text}" in paths

            def one(x: Column) -> Column:
                role = F.coalesce(x.getField(rule.role).cast("string"), F.lit(""))
                text = F.coalesce(x.getField(rule.text).cast("string"), F.lit("")) if has_text else F.lit("")
                return F.struct(F.coalesce(F.try_element_at(names, role), role).alias("role"), text.alias("text"))

            parts.append(F.transform(_quoted(rule.array), one).cast(TURNS))
    return F.concat(*parts)


def canonical_turns(records: DataFrame, key: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(key, layout, turns): the turns of each record, by the mapping that its field paths select.

    A path is there if it holds a value, in an array if any element does. Null roles and texts
    inside a message list become empty ones, a null element is a turn without role and text. A
    record whose paths no mapping covers (also one without any) has a null ``layout`` and no
    turns. Each row is a record of its own, repeated rows and keys and null keys included. Other
    columns are neither looked at nor returned; an empty table gives an empty one.
    """
    paths = set(field_paths(records.schema))
    chosen, layout = F.array().cast(TURNS), F.lit(None).cast("string")
    for rule in layouts:
        if set(rule.needs) <= paths:
            mine = F.col("_fingerprint").isin(rule.fingerprints())
            chosen, layout = F.when(mine, _turns(rule, paths)).otherwise(chosen), F.when(mine, rule.name).otherwise(layout)
    marked = records.withColumn("_fingerprint", fingerprint(records.schema, layouts))
    return marked.select(_quoted(key).alias(key), layout.alias("layout"), chosen.alias("turns"))


def escaped(text: Column) -> Column:
    """The text with doubled backslashes and with one inside every mark."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (OPEN, CLOSE):
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``: between doubled backslashes every other one goes."""
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\"), F.lit(""))), "\\")


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _unescaped_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)
    plain = F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit("")))
    return F.array_join(plain, "\\")


def format_turns(turns: Column) -> Column:
    """array<struct<text, loss>>: the pieces of the formatted text; their texts one after the other
    are the formatted text, and ``loss`` is true for the (escaped) texts of assistants alone."""

    def pieces(t: Column) -> Column:
        def piece(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        opening = F.concat(F.lit(OPEN), _escaped_role(t["role"]), F.lit("\n"))
        return F.array(piece(opening, F.lit(False)), piece(escaped(t["text"]), t["role"] == "assistant"),
                       piece(F.lit(CLOSE + "\n"), F.lit(False)))

    return F.flatten(F.transform(turns, pieces))


def formatted(pieces: Column) -> Column:
    """The formatted text of the pieces."""
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def read_turns(text: Column) -> Column:
    """The turns that a formatted text marks, as they were before formatting."""
    ended = F.split(text, CLOSE + "\n", -1)

    def one(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.char_length(role) + 2)
        return F.struct(_unescaped_role(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"), unescaped(body).alias("text"))

    return F.transform(F.slice(ended, F.lit(1), F.size(ended) - 1), one)


def read_loss(pieces: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescaped(p["text"]))


def format_chats(records: DataFrame, key: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(key, layout, pieces, formatted) of every record; see ``canonical_turns`` for what a record gives.

    A record without turns has no pieces and an empty formatted text. A record is one training
    example and one row before and after; nothing is grouped or shuffled here.
    """
    turns = canonical_turns(records, key, layouts)
    done = turns.select(key, "layout", format_turns(F.col("turns")).alias("pieces"))
    return done.withColumn("formatted", formatted(F.col("pieces")))


def records_of_rows(rows: DataFrame, key: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record per conversation from a table of turns, in the plainest layout that can hold it.

    A question with its answer, with or without a system text, is a prompt record; everything else
    is a message record. Turns are in order of ``turn`` (null first), then role, then text; repeated
    rows are repeated turns. Null roles and texts are empty; rows without a key form one
    conversation, as in GROUP BY. The turns of one conversation have to fit one row, as its
    formatted text does.
    """
    filled = rows.select(F.col(key).alias("key"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("content")).alias("row"))
    each = filled.groupBy("key").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    roles = F.transform("rows", lambda r: r["role"])
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    led = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    said = [F.get("rows", F.lit(k))["content"] for k in range(3)]
    return each.select(
        F.col("key").alias(key),
        F.when(led, said[0]).alias("system"),
        F.when(pair, said[0]).when(led, said[1]).alias("prompt"),
        F.when(pair, said[1]).when(led, said[2]).alias("completion"),
        F.when(~(pair | led), F.transform("rows", lambda r: r.dropFields("turn"))).alias("messages"))
