"""Repair of conversation structure by the cheapest edits, found on an automaton that all conversations share.

A turn counts only by its sign: the initial of its role and whether it has to go (blank or a duplicate) or is cut off.
What the rest of a conversation costs depends on its signs alone, and endings are much alike, so signatures are
minimised from the end:

1. ``signs``: equal turns are one row with a number; a turn whose role and text came earlier in its conversation has to
   go.  The first of equal turns is found by an aggregation and an equality join on unique keys.
2. ``blocks``: each conversation is read from its end and cut to blocks of ``BLOCK`` signs.  A block carries the class of
   what follows it: the costs still to pay, by state of the grammar, less the least.  There are few such classes.
3. ``repairs``: the distinct blocks, sorted by their endings, are read as an automaton that shares suffixes: a stack
   holds the nodes of the current block from its end, and the next block keeps the nodes of the ending it shares.  A node
   gets its cost to go and its best edits once for each state of the grammar, whatever conversations pass it.
4. ``repaired``: blocks with their edits and the turns meet again by conversation, in order, in one stream.

Edits: K(eep), R(ename the role), D(elete), I(nsert); the roles left have to read ``(s?(ua)+)?`` by their initials.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import hot_join, saved

#: Costs of the edits, and of a turn that stays cut off.
RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
BLOCK = 64
#: Conversations end here; other tails are numbers of classes.
END = -1

#: States of the grammar: at the start, after the system, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user or an assistant leads, whichever the state asks for.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = ("user", "user", "assistant", "user")
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
#: Signs: a role's initial (``o``: another one), large if the turn is cut off; ``D`` has to go.
_SIGNS = "suaoSUAOD"
_FAR = 10**9

Costs = tuple[int, int, int, int]


def _inserted(costs: list[int], edits: list[tuple[str, int, bool]]) -> None:
    """Lets states go on to others by insertions, where that is cheaper or the letter is smaller."""
    for _ in range(3):
        for state in range(4):
            price = INSERT + costs[_NEXT[state]]
            if (price, "I") < (costs[state], edits[state][0]):
                costs[state], edits[state] = price, ("I", _NEXT[state], False)


def end_of_all() -> tuple[Costs, list[tuple[str, int, bool]]]:
    costs, edits = [0, _FAR, _FAR, 0], [("", x, False) for x in range(4)]
    _inserted(costs, edits)
    return tuple(costs), edits


@lru_cache(maxsize=None)
def before(sign: str, after: Costs) -> tuple[Costs, tuple[tuple[str, int, bool], ...]]:
    """Costs to go, by state, before a turn, and the first edit: letter, state it leads to, whether the turn is used up.

    Of equally cheap edits the smaller letter goes first; different edits of a state have different letters, so the
    whole list of edits is the least one too.
    """
    extra = CUT_OFF if sign in "SUAO" else 0
    costs, edits = [], []
    for state in range(4):
        best = (DELETE + after[state], "D", state)
        if sign != "D":
            best = min(best, (RENAME + extra + after[_NEXT[state]], "R", _NEXT[state]))
            to = _KEPT[sign.lower()].get(state)
            if to is not None:
                best = min(best, (extra + after[to], "K", to))
        costs.append(best[0])
        edits.append((best[1], best[2], True))
    _inserted(costs, edits)
    return tuple(costs), tuple(edits)


@lru_cache(maxsize=1)
def classes() -> tuple[list[Costs], list[dict[str, int]]]:
    """All classes of endings, the empty one first, and the class each sign leads to from each."""
    known = [end_of_all()[0]]
    steps: list[dict[str, int]] = []
    while len(steps) < len(known):
        here = {}
        for sign in _SIGNS:
            costs, _ = before(sign, known[len(steps)])
            least = tuple(x - min(costs) for x in costs)
            if least not in known:
                known.append(least)
            here[sign] = known.index(least)
        steps.append(here)
    return known, steps


# -- damage ---------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, role, text, times)`` of the rows that are left, nulls of role and text as one blank.

    By CRC-32 of ``conv_id:turn`` (a null is one blank) modulo 20: 0 drops the row, 1 empties its text, 2 takes
    its full stops, exclamation and question marks, 3 repeats it, 4 makes the user its role.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    return conversations.where(kind != 0).select(
        _name().alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(blank("role")).alias("role"),
        text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def _name() -> Column:
    """A key that is not null: ``0`` without a conversation id, else ``1`` and the id."""
    return F.coalesce(F.concat(F.lit("1"), F.col("conv_id").cast("string")), F.lit("0"))


def signs(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, body, times, blank, first, cut)``, one row for equal turns (conversation, turn, role, text).

    ``body`` is a digest of the text; ``first``: no earlier turn of the conversation has this role and text.
    """
    inked = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    one = rows.select(
        "conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("body"), "times", (inked == "").alias("blank"),
        (~F.substring(inked, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    turns = one.groupBy("conv", "turn", "role", "body").agg(F.sum("times").alias("times"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    turns = saved(turns)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")  # null turns come first
    firsts = turns.groupBy("conv", "role", "body").agg(F.min(place).alias("place")).select(
        "conv", "role", "body", F.col("place.turn").alias("turn"), F.lit(True).alias("first")
    )
    keys = ["conv", "role", "body"]
    left, right = turns.alias("l"), firsts.alias("r")
    same = [F.col(f"l.{x}") == F.col(f"r.{x}") for x in keys]
    joined = left.join(right, [*same, F.col("l.turn").eqNullSafe(F.col("r.turn"))], "left")
    return joined.select("l.*", F.coalesce("r.first", F.lit(False)).alias("first"))


# -- the automaton --------------------------------------------------------------------------------------


_ORDER = ("turn", "role", "body")
_BLOCK = "conv string, turn long, role string, body binary, number long, tail int, word string"


def blocks(turns: DataFrame) -> DataFrame:
    """Signs of each conversation in blocks, numbered from its end; ``turn``, ``role``, ``body`` are those of the first turn.

    A task reads conversations as a stream and holds one block; a conversation of any length goes through it.
    """
    near = turns.repartition("conv").sortWithinPartitions("conv", *(F.col(x).desc() for x in _ORDER))
    return near.select("conv", *_ORDER, "times", "blank", "first", "cut").mapInArrow(_cut, _BLOCK)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, steps = classes()
    conv = first = None
    word: list[str] = []
    tail, number, now = END, 0, 0
    out: list[tuple] = []

    def close() -> None:
        nonlocal tail, number
        if word:
            out.append((*first, number, tail, "".join(reversed(word))))
            tail, number = now, number + 1
            word.clear()

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for name, turn, role, body, times, blank, fresh, off in zip(*columns):
            if name != conv:
                close()
                conv, tail, number, now = name, END, 0, 0
            own = "D" if blank or not fresh else role[:1] if role[:1] in ("s", "u", "a") else "o"
            own = own.upper() if off else own
            for i in range(times):  # equal turns follow the first of them, so from the end they come before it
                sign = own if i == times - 1 else "D"
                word.append(sign)
                now, first = steps[now][sign], (name, turn, role, body)
                if len(word) == BLOCK:
                    close()
                    if len(out) >= 1 << 14:
                        yield _batch(out, _BLOCK)
                        out = []
        if out:
            yield _batch(out, _BLOCK)
            out = []
    close()
    if out:
        yield _batch(out, _BLOCK)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(x), kinds[kind]) for x, (_, kind) in zip(zip(*rows), fields)], names=[x for x, _ in fields])


_REPAIR = "tail int, word string, audits array<string>, exits array<int>, costs array<int>"


def repairs(words: DataFrame) -> DataFrame:
    """``(tail, word)`` distinct to ``(tail, word, audits, exits, costs)``, each by state of the grammar before the word.

    Sorted by ending, words that share one are neighbours, so a node of the automaton is made once in a range, and only the nodes
    of one word are held.
    """
    ending = F.reverse("word")
    return words.repartitionByRange("tail", ending).sortWithinPartitions("tail", ending).select("tail", "word").mapInArrow(_walked, _REPAIR)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, _ = classes()
    tail, nodes, last = None, [], ""
    for batch in batches:
        out = []
        for after, word in zip(batch.column("tail").to_pylist(), batch.column("word").to_pylist()):
            back = word[::-1]
            if after != tail:
                tail, last = after, ""
                nodes = [_leaf(known, after)]
            shared = 0
            while shared < min(len(last), len(back)) and last[shared] == back[shared]:
                shared += 1
            del nodes[shared + 1 :]
            for sign in back[shared:]:
                nodes.append(_node(sign, nodes[-1]))
            last = back
            costs, audits, exits, paid = nodes[-1]
            out.append((after, word, audits, exits, paid))
        if out:
            yield _batch(out, _REPAIR)


def _leaf(known: list[Costs], tail: int) -> tuple:
    """The node a block ends in: costs to go, and by state the edits to the end of the block, where they lead, what they cost."""
    if tail != END:
        return known[tail], [""] * 4, [0, 1, 2, 3], [0] * 4
    costs, edits = end_of_all()
    return costs, *_chosen(edits, [""] * 4, [0, 1, 2, 3], [0] * 4, costs, (0, 0, 0, 0))


def _node(sign: str, after: tuple) -> tuple:
    costs, edits = before(sign, after[0])
    return costs, *_chosen(edits, *after[1:], costs, after[0])


def _chosen(edits, audits, exits, paid, costs, later) -> tuple[list[str], list[int], list[int]]:
    """Edits from each state on: the first one, then those of the node behind it (or of this node, after an insertion)."""
    out: list[tuple] = []
    for state in range(4):
        text, at = "", state
        while edits[at][0] == "I":
            text, at = text + "I", edits[at][1]
        letter, to, used = edits[at]
        beyond = to if used else at
        price = costs[state] - later[beyond] + paid[beyond]
        out.append((text + letter + audits[beyond], exits[beyond], price))
    return tuple(map(list, zip(*out)))


# -- the whole -------------------------------------------------------------------------------------------


_RESULT = "conv string, illegal long, cost long, audit string, repaired_sha256 string"


def repaired(conversations: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, one row per ``conv_id``.

    Rows without an id are one conversation, without id.  Turns are in order of ``turn``, null first, turns of one number
    by role and digest of their text.  ``gaps`` counts missing turn numbers between the least and the greatest, ``illegal``
    neighbours whose roles may not follow each other.  A conversation of which no row is left has zeros and nothing to do.
    A role that does not begin with s, u or a (an empty one too) can only be renamed or deleted.  Other columns are not read.
    """
    rows = damaged(conversations)
    turns = saved(signs(rows))
    parts = saved(blocks(turns))
    words = saved(parts.groupBy("tail", "word").agg(F.count("*").alias("n")))
    found = saved(repairs(words))
    planned = hot_join(parts, found, words, ["tail", "word"])
    none = lambda kind: F.lit(None).cast(kind)
    plan = planned.select("conv", *_ORDER, F.lit(0).alias("kind"), (-F.col("number")).alias("number"), none("string").alias("text"), none("long").alias("times"), "audits", "exits", "costs")
    said = rows.select(
        "conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("body"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("number"), "text", "times",
        none("array<string>").alias("audits"), none("array<int>").alias("exits"), none("array<int>").alias("costs"),
    )
    near = plan.unionByName(said).repartition("conv").sortWithinPartitions("conv", *(F.col(x).asc_nulls_first() for x in _ORDER), "kind", "number")
    done = near.drop("turn", "body", "number").mapInArrow(_applied, _RESULT)
    nothing = hashlib.sha256(b"").hexdigest()
    ids = conversations.groupBy("conv_id").agg(F.lit(1).alias("one")).select(_name().alias("conv"), "conv_id")
    must = F.when(F.col("blank"), F.col("times")).otherwise(0)
    counted = turns.groupBy("conv").agg(
        (F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)) - F.countDistinct("turn")).alias("gaps"),
        F.sum(must).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("first"), F.col("times") - 1).otherwise(F.col("times"))).alias("duplicate"),
        F.sum(F.when(F.col("first") & ~F.col("blank") & F.col("cut"), 1).otherwise(0)).alias("truncated"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return ids.join(counted, "conv", "left").join(done, "conv", "left").select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


class _Talk:
    """The conversation that a stream is at: its state, and what has been read and written so far."""

    def __init__(self, conv: str):
        self.conv, self.state, self.cost, self.illegal, self.role = conv, START, 0, 0, None
        self.way = START  # state the blocks read so far lead to
        self.edits: list[str] = []
        self.todo, self.at = "", 0
        self.hash, self.begun = hashlib.sha256(), False

    def block(self, audits: list[str], exits: list[int], costs: list[int]) -> None:
        self.edits.append(audits[self.way])
        self.todo, self.at = self.todo[self.at :] + audits[self.way], 0
        self.cost += costs[self.way]
        self.way = exits[self.way]

    def turn(self, role: str, text: str, times: int) -> None:
        for _ in range(times):
            here = role[:1]
            if self.role is not None and self.role + here not in ("su", "ua", "au"):
                self.illegal += 1
            self.role = here
            self.insertions()
            edit = self.todo[self.at]
            self.at += 1
            if edit == "K":
                self.write(role, text)
                self.state = _KEPT[here][self.state]
            elif edit == "R":
                self.write(_ROLE[self.state], text)
                self.state = _NEXT[self.state]

    def insertions(self) -> None:
        while self.at < len(self.todo) and self.todo[self.at] == "I":
            self.at += 1
            self.write(_ROLE[self.state], "")
            self.state = _NEXT[self.state]

    def write(self, role: str, text: str) -> None:
        if self.begun:
            self.hash.update(b"\n")
        self.begun = True
        self.hash.update(f"{role}:{text}".encode("utf-8", "replace"))

    def row(self) -> tuple:
        self.insertions()
        return self.conv, self.illegal, self.cost, "".join(self.edits), self.hash.hexdigest()


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plays the edits on the turns; blocks come before their first turn, and wait if it repeats."""
    talk = None
    for batch in batches:
        out = []
        names = ("conv", "role", "kind", "text", "times", "audits", "exits", "costs")
        for conv, role, kind, text, times, audits, exits, costs in zip(*(batch.column(x).to_pylist() for x in names)):
            if talk is None or conv != talk.conv:
                if talk is not None:
                    out.append(talk.row())
                talk = _Talk(conv)
            if kind:
                talk.turn(role, text, times)
            else:
                talk.block(audits, exits, costs)
        if out:
            yield _batch(out, _RESULT)
    if talk is not None:
        yield _batch([talk.row()], _RESULT)
