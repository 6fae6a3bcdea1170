"""Perspective rotation: each participant of a conversation once as the assistant, the others as named users.

A conversation is rendered in parts of ``PART_TURNS`` messages, so that no task gathers a conversation of unbounded
length; the parts in order, put together, are the dialogue, and all offsets count from the start of the dialogue.
Messages are numbered by counts of sorted ranges (``merkle.placed``), so equal and missing turns are cut into parts like
any others, and lengths before a part are running sums over narrow rows, in two steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.llm.merkle import placed
from emberscope.operators.keyed import running_totals

#: The marks of the format and the role that is nobody's perspective.
SYSTEM = "system"
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
PART_TURNS = 64
#: Parts whose lengths are summed in one step.
_STEP_BITS = 10


def rotations(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``(conv_id, perspective, part, offset, n_turns, text, mask, n_masked)``, one row per participant and part.

    Participants are the roles of a conversation but ``system``; a null role is the participant ``unknown``.  Messages
    are ordered by turn (null last), then role, then text; equal messages are messages each; a null text is empty.  In the
    rendering of a participant their messages are the assistant's, system messages stay the system's, and others are
    users by name.  Marks inside a text are broken up by a blank.  ``offset``: code points of the dialogue before
    the part.  ``mask``: ``start:end`` (code points of the dialogue, end exclusive) of what the assistant has to learn, text
    and end mark, comma-joined.  A conversation of system messages only, and rows without ``conv_id``, give nothing.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    message = conversations.where("conv_id is not null").select(
        "conv_id", F.col("conv_id").cast("string").alias("tree"), F.coalesce(F.col("turn").cast("long"), F.lit(2**62)).alias("order"),
        role.alias("role"), F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"<\|", "< |").alias("body"),
    )
    numbered = placed(message, "order", "role", "body").withColumn("part", F.floor(F.col("index") / part_turns).cast("long"))
    parts = numbered.groupBy("conv_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("index", "role", "body"))).alias("messages")  # no more than part_turns
    )
    return _rendered(parts.join(_grid(numbered), ["conv_id", "part"]))


def _grid(numbered: DataFrame) -> DataFrame:
    """``(conv_id, part, perspective, offset)`` for every participant and part."""
    length = F.length(_head(F.col("role"), F.lit(None))) + F.length("body") + len(END) + 1
    speaks = numbered.groupBy("conv_id", "part", "role").agg(F.count("*").alias("n"), F.sum(length).alias("length"))
    whole = speaks.groupBy("conv_id", "part").agg(F.sum("length").alias("length"))
    speakers = speaks.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("perspective")).distinct()
    own = speaks.select("conv_id", "part", F.col("role").alias("perspective"), "n")
    saved_length = F.length(_head(F.col("perspective"), F.lit(None))) - F.length(_head(F.col("perspective"), F.col("perspective")))
    grid = whole.join(speakers, "conv_id").join(own, ["conv_id", "part", "perspective"], "left").select(
        "conv_id", "part", "perspective", (F.col("length") - F.coalesce("n", F.lit(0)) * saved_length).alias("length"),
        F.shiftright("part", _STEP_BITS).alias("step"),
    )
    summed = running_totals(grid, ["conv_id", "perspective"], "step", "part", sums={"upto": "length"})
    return summed.select("conv_id", "part", "perspective", (F.col("upto") - F.col("length")).alias("offset"))


def _head(role: Column, perspective: Column) -> Column:
    """What stands before a message of ``role`` where ``perspective`` is the assistant."""
    name = F.when(role == SYSTEM, F.lit(SYSTEM)).when(role == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(OPEN), name, F.lit(CLOSE + "\n"))


def _rendered(parts: DataFrame) -> DataFrame:
    own = lambda m: m["role"] == F.col("perspective")
    head = lambda m: _head(m["role"], F.col("perspective"))
    whole = F.transform("messages", lambda m: F.concat(head(m), m["body"], F.lit(END + "\n")))
    walked = F.aggregate(
        "messages",
        F.struct(F.col("offset").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("n")),
        lambda s, m: F.struct(
            (s["at"] + F.length(head(m)) + F.length(m["body"]) + len(END) + 1).alias("at"),
            F.when(own(m), F.concat(s["spans"], F.array(F.concat_ws(
                ":", s["at"] + F.length(head(m)), s["at"] + F.length(head(m)) + F.length(m["body"]) + len(END)
            )))).otherwise(s["spans"]).alias("spans"),
            (s["n"] + F.when(own(m), F.length(m["body"]) + len(END)).otherwise(0)).alias("n"),
        ),
    )
    done = parts.withColumn("walked", walked)
    return done.select(
        "conv_id", "perspective", "part", "offset", F.size("messages").cast("long").alias("n_turns"),
        F.array_join(whole, "").alias("text"), F.array_join("walked.spans", ",").alias("mask"), F.col("walked.n").cast("long").alias("n_masked"),
    )


ORACLE = f"""
WITH message AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), replace(coalesce(text, ''), '<|', '< |')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
speaker AS (SELECT DISTINCT conv_id, role AS perspective FROM message WHERE role <> '{SYSTEM}'),
line AS (
  SELECT m.conv_id, s.perspective, CAST((m.place - 1) // {PART_TURNS} AS BIGINT) AS part, m.place, m.role, m.body,
    '{OPEN}' || CASE WHEN m.role = '{SYSTEM}' THEN '{SYSTEM}' WHEN m.role = s.perspective THEN 'assistant' ELSE 'user name=' || m.role END
      || '{CLOSE}' || chr(10) AS head
  FROM message m JOIN speaker s ON m.conv_id = s.conv_id),
placed AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(body) + {len(END) + 1}) OVER (
    PARTITION BY conv_id, perspective ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM line)
SELECT conv_id, perspective, part, min(pos) AS "offset", count(*) AS n_turns,
  string_agg(head || body || '{END}' || chr(10), '' ORDER BY place) AS text,
  coalesce(string_agg(CASE WHEN role = perspective THEN CAST(pos + length(head) AS VARCHAR) || ':' || CAST(pos + length(head) + length(body) + {len(END)} AS VARCHAR) END,
    ',' ORDER BY place), '') AS mask,
  CAST(sum(CASE WHEN role = perspective THEN length(body) + {len(END)} ELSE 0 END) AS BIGINT) AS n_masked
FROM placed GROUP BY conv_id, perspective, part
"""
