"""Quotation linking: conversations in reply order, from messages that quote each other.

A line's quote level is the number of ``>`` before it. Lines of one level that follow each
other are a passage. Every line of a passage, in lower case and with single spaces, is
hashed and joined with the lines that earlier messages of the same conversation wrote
themselves; it speaks for the latest of them. A message replies to the one that most lines
of its lowest quoted level speak for, the latest of equals. Following the replies gives
each message the root of its thread and its depth; a conversation ordered by root, depth
and turn has every message after the one it replies to. The text returned is what the
message wrote itself: without quotes and without the line that announces one.

Messages are known by conversation and turn. Rows that repeat both are one message with
the lines of all; each row keeps its own text. A null text has no lines; a null
conversation or turn takes no part in links: such rows, and messages that quote nothing
known, are roots at depth 0. Columns beyond those named are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.session import written

_QUOTE = re.compile(r"(?:[ \t]*>)+[ \t]?")
_ANNOUNCED = re.compile(r"(?:On\b.*\bwrote|Am\b.*\bschrieb.*|Le\b.*a écrit|El\b.*escribió) ?:\s*")


def parsed(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and (level, text) of its quoted passages.

    A line that announces a quotation is dropped if the next line is quoted.
    """
    lines = []
    for line in text.split("\n"):
        found = _QUOTE.match(line)
        mark = found.group() if found else ""
        lines.append((mark.count(">"), line[len(mark) :]))
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for i, (level, line) in enumerate(lines):
        if level == 0:
            quoted_next = i + 1 < len(lines) and lines[i + 1][0] > 0
            if not (quoted_next and _ANNOUNCED.fullmatch(line)):
                own.append(line)
        elif level == before:
            passages[-1][1].append(line)
        else:
            passages.append((level, [line]))
        before = level
    return "\n".join(own), [(level, "\n".join(part)) for level, part in passages]


_PARSED = "struct<own:string,passages:array<struct<level:int,text:string>>>"


def _parsed(column: pa.Array) -> pa.Array:
    kind = pa.struct(
        [
            ("own", pa.string()),
            ("passages", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))),
        ]
    )
    rows = []
    for value in column.to_pylist():
        if value is None:
            rows.append({"own": None, "passages": []})
            continue
        own, passages = parsed(value)
        rows.append({"own": own, "passages": [{"level": n, "text": t} for n, t in passages]})
    return pa.array(rows, kind)


def _line_hashes(text: Column) -> Column:
    """A hash of every line with anything but spaces in it."""
    lines = F.transform(
        F.split(text, "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    )
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x))


def parsed_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, passages): own texts and quoted passages, written."""
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.arrow_udf(_parsed, _PARSED)("text").alias("p"),
    )
    return written(
        rows.select("conv_id", "turn", "role", F.col("p.own").alias("text"), "p.passages"),
        "messages",
    )


def replies(parsed_: DataFrame) -> DataFrame:
    """(conv_id, turn, parent) of every message that quotes a known one."""
    known = parsed_.where("conv_id is not null and turn is not null")
    own = known.select("conv_id", "turn", F.explode(_line_hashes(F.col("text"))).alias("line"))
    quoted = known.select("conv_id", "turn", F.explode("passages").alias("p")).select(
        "conv_id",
        "turn",
        F.explode(_line_hashes(F.col("p.text"))).alias("line"),
        F.col("p.level").alias("level"),
    )
    both = own.select("*", F.lit(None).cast("int").alias("level")).union(quoted)
    # only lines that someone quotes and someone wrote; counted before they are sorted
    met = (
        both.groupBy("conv_id", "line", "turn", "level")
        .agg(F.count("*").alias("n"))
        .withColumn("wrote", F.when(F.col("level").isNull(), F.col("turn")))
    )
    earlier = (
        Window.partitionBy("conv_id", "line")
        .orderBy("turn")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    spoken = met.withColumn("parent", F.max("wrote").over(earlier)).where(
        "level is not null and parent is not null"
    )
    votes = spoken.groupBy("conv_id", "turn", "level", "parent").agg(F.sum("n").alias("n"))
    return votes.groupBy("conv_id", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("l"), "n", "parent")).getField("parent").alias("parent")
    )


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, root, depth) of every message of ``(conv_id, turn, parent)``.

    Each round doubles the length of all jumps towards the root, so there are as many
    rounds as the logarithm of the longest thread; each is written to the shared folder.
    A message that has reached its root is settled and only looked up from then on.
    """
    active = written(
        parents.select("*", F.col("parent").alias("up"), F.lit(1).alias("steps")), "jumps"
    )
    settled = active.limit(0)
    while True:
        known = active.withColumn("ended", F.lit(False)).union(
            settled.withColumn("ended", F.lit(True))
        )
        upper = known.select(
            "conv_id",
            F.col("turn").alias("up"),
            F.col("up").alias("further"),
            F.col("steps").alias("more"),
            "ended",
        )
        moved = active.join(upper, ["conv_id", "up"], "left").select(
            "conv_id",
            "turn",
            "parent",
            F.coalesce("further", "up").alias("up"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.coalesce("ended", F.lit(True)).alias("ended"),
        )
        moved = written(moved, "jumps")
        settled = settled.union(moved.where("ended").drop("ended"))
        active = moved.where("not ended").drop("ended")
        if active.isEmpty():
            return settled.select(
                "conv_id",
                "turn",
                "parent",
                F.col("up").alias("root"),
                F.col("steps").alias("depth"),
            )


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, parent_turn, root_turn, depth) of every message; the
    reply order of a conversation is by root_turn, depth and turn."""
    rows = parsed_messages(messages)
    placed = threads(replies(rows))
    return rows.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def quoting(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the messages as a mail program sends them, each after
    the turn before it, quoted, and the one before that, quoted twice."""
    turns = messages.select("conv_id", "turn", "text").where("text is not null")

    def back(by: int, mark: str) -> DataFrame:
        lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit(mark), x))
        return turns.groupBy("conv_id", (F.col("turn") + by).alias("turn")).agg(
            F.min(F.array_join(lines, "\n")).alias(f"quoted{by}")
        )

    return (
        messages.join(back(2, ">> "), ["conv_id", "turn"], "left")
        .join(back(1, "> "), ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            F.when(
                F.col("text").isNotNull(),
                F.concat_ws(
                    "\n", F.when(F.col("quoted1").isNotNull(), F.col("quoted2")), "quoted1", "text"
                ),
            ).alias("text"),
        )
    )
