"""Repair of conversation structure: the cheapest edits that make the turns read ``system? (user assistant)+``.

Rows are dealt by conversation and sorted by turn, and a table-driven dynamic program runs along the sorted
stream, its state carried across Arrow batches.  It has four states (nothing yet, after system, after user,
after assistant) and runs backwards, from the last turn to the first: the cheapest way to end from each state
needs only what follows, and each state has at most one edit of each kind, so among equal costs the least
letter is the least string.  A row leaves one byte, two bits for each state.  Those bytes are the
backpointers; a block of them is given out as a row of a shared table whenever ``block`` rows are full, so a
giant conversation holds neither its turns nor its backpointers in a worker, and a lost executor loses nothing.
A second stream, in turn order, gets the blocks just before the rows they speak of and gives out the repaired turns
or their digest.  A whole conversation runs through one task, but is never held there; only its edit string
(one letter a row) is, since it is a result.

Faults, the first that holds: ``blank`` (only white space), ``duplicate`` (role and text stand earlier in the
conversation), ``truncated`` (last character but white space is not ``.``, ``!`` or ``?``).  Costs: Keep 0, Rerole to user or
assistant 3, Delete 4, Insert an empty user or assistant turn 3; blank and duplicate rows must be deleted, a
truncated row that stays costs 3 more.

Defined cases: a null role or text is one space (so it is blank, or fits no role); an empty role fits nowhere;
null turns come first; turns with equal number are ordered by a digest of role and text; a null ``conv_id`` is a
conversation of its own; repeated rows are duplicates; a conversation without rows has zeros, no edits and the
digest of an empty string; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidloom.llm.common import ready, spread, strip_space, write_table

DELETE, INSERT, KEEP, REROLE = range(4)  # in the order of their letters
LETTERS = "DIKR"
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
FAULTS = ("none", "blank", "duplicate", "truncated")
ROLES = ("system", "user", "assistant", "other")
# The role that an inserted or changed turn gets in each state, and the state after it.
NEEDED = ("user", "user", "assistant", "user")
AFTER = (USER, USER, ASSISTANT, USER)
# The state after keeping a turn of a role in a state; -1 where it may not stand.
KEPT = ((SYSTEM, USER, -1, -1), (-1, USER, -1, -1), (-1, -1, ASSISTANT, -1), (-1, USER, -1, -1))
AT_END = (0, 2 * INSERT_COST, INSERT_COST, 0)
LEGAL = {(0, 1), (1, 2), (2, 1)}
BLOCK = 1 << 16
OUT_ROWS, OUT_CHARS = 2000, 1 << 20

STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def step(costs: tuple[int, ...], role: int, fault: int) -> tuple[tuple[int, ...], int]:
    """Costs before a row from the costs after it, and the row's byte of choices."""
    extra = TRUNCATED_COST if fault == 3 else 0
    own = []
    for state in range(4):
        ways = [(DELETE_COST + costs[state], DELETE)]
        if fault not in (1, 2):
            if KEPT[state][role] >= 0:
                ways.append((KEEP_COST + extra + costs[KEPT[state][role]], KEEP))
            ways.append((REROLE_COST + extra + costs[AFTER[state]], REROLE))
        own.append(min(ways))
    # two insertions in a row lead from a state to itself, so one look at the others is enough for them
    user, assistant = (min(own[a][0], INSERT_COST + own[b][0]) for a, b in ((USER, ASSISTANT), (ASSISTANT, USER)))
    reached = {USER: user, ASSISTANT: assistant}
    best = [min(own[state], (INSERT_COST + reached[AFTER[state]], INSERT)) for state in range(4)]
    return tuple(c for c, _ in best), sum(edit << (2 * state) for state, (_, edit) in enumerate(best))


class Steps:
    """:func:`step` with what it has seen kept, costs taken from their least; there are few such states."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}

    def __call__(self, costs: tuple[int, ...], role: int, fault: int) -> tuple[tuple[int, ...], int, int]:
        found = self.known.get((costs, role, fault))
        if found is None:
            raw, choice = step(costs, role, fault)
            low = min(raw)
            found = self.known[costs, role, fault] = tuple(c - low for c in raw), low, choice
        return found


def _marked(turns: DataFrame) -> DataFrame:
    """``conv, turn, no_turn, digest, role, text`` with nulls replaced; ``conv`` is the id as text."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return turns.select(
        F.col("conv_id").cast("string").alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"),
        F.md5(F.concat(role, F.lit("\0"), text)).alias("digest"), role.alias("role"), text.alias("text"))


def _role_number(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _backpointers(marked: DataFrame, conversations: DataFrame, block: int) -> DataFrame:
    """``conv, kind, no_turn, turn, digest, place, choices, stats``: the choices of a conversation in blocks.

    Kind 0 stands for the conversation: its statistics and the block of its first rows.  Kind 1 is a further block, with the
    sort key of the first row it speaks of.  ``place`` counts from the end of the conversation.
    """
    inner = strip_space(F.col("text"))
    last = F.substring(inner, -1, 1)
    narrow = marked.select(
        "conv", "turn", "no_turn", "digest", _role_number(F.col("role")).alias("role"),
        F.when(inner == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3).alias("fault"))
    heads = conversations.select(F.col("conv_id").cast("string").alias("conv")).distinct().select(
        "conv", F.lit(0).cast("long").alias("turn"), F.lit(True).alias("no_turn"), F.lit("").alias("digest"),
        F.lit(-1).alias("role"), F.lit(0).alias("fault"))
    rows = narrow.unionByName(heads).repartition(spread(marked.sparkSession), "conv")
    # the deal by conversation serves this window too
    seen = F.row_number().over(Window.partitionBy("conv", "digest").orderBy(F.desc("no_turn"), "turn"))
    rows = rows.withColumn("copy", seen).withColumn(
        "fault", F.when((F.col("fault") != 1) & (F.col("copy") > 1), 2).otherwise(F.col("fault")))
    # last turn first; the line for the conversation itself, without a role, ends it
    rows = rows.sortWithinPartitions(
        "conv", F.desc(F.col("role") >= 0), "no_turn", F.desc("turn"), F.desc("digest"), F.desc("copy")).drop("copy")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, started, out = Steps(), False, []
        conv = costs = base = choices = place = counts = gaps = later = None

        def close() -> None:
            first, final, different = gaps
            span = final - first + 1 - different if different else 0
            out.append((conv, 0, False, 0, "", place, bytes(choices),
                        [span, counts[1], counts[2], counts[3], counts[4], base + costs[BEGIN]]))

        def table() -> pd.DataFrame:
            done = pd.DataFrame(out, columns=["conv", "kind", "no_turn", "turn", "digest", "place", "choices", "stats"])
            out.clear()
            return done

        for batch in batches:
            columns = (batch[c].tolist() for c in ("conv", "turn", "no_turn", "digest", "role", "fault"))
            for own, turn, no_turn, digest, role, fault in zip(*columns, strict=True):
                if not started or own != conv:
                    if started:
                        close()
                    started, conv, costs, base, place = True, own, AT_END, 0, 0
                    choices, counts, gaps, later = bytearray(), [0] * 5, [0, 0, 0], None
                if role < 0:
                    continue
                costs, low, choice = steps(costs, role, fault)
                base += low
                choices.append(choice)
                place += 1
                counts[fault] += 1
                if later is not None and (role, later) not in LEGAL:
                    counts[4] += 1
                later = role
                if not no_turn:
                    if not gaps[2]:
                        gaps = [turn, turn, 1]
                    elif turn != gaps[0]:
                        gaps = [turn, gaps[1], gaps[2] + 1]
                if len(choices) == block:
                    out.append((conv, 1, no_turn, turn, digest, place, bytes(choices), None))
                    choices.clear()
                if len(out) >= OUT_ROWS:
                    yield table()
        if started:
            close()
        if out:
            yield table()

    return rows.mapInPandas(scan, "conv string, kind int, no_turn boolean, turn long, digest string, place long, "
                                  "choices binary, stats array<bigint>")


class Repair:
    """Walks one conversation in turn order along its choices."""

    def __init__(self, conv: str | None, stats: np.ndarray) -> None:
        self.conv, self.stats = conv, stats
        self.state, self.edits, self.n = BEGIN, bytearray(), 0
        self.blocks: list[bytes] = []
        self.at = -1

    def add_block(self, choices: bytes) -> None:
        # choices were written from the end
        self.blocks.append(choices[::-1])

    def _choice(self) -> int:
        self.at += 1
        while self.at >= len(self.blocks[0]):
            self.at -= len(self.blocks.pop(0))
        return self.blocks[0][self.at]

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """``(edit, role, text)`` of what comes out at a row: inserted turns, then the row itself."""
        choice = self._choice()
        while True:
            edit = (choice >> (2 * self.state)) & 3
            self.edits.append(ord(LETTERS[edit]))
            if edit == DELETE:
                return
            if edit == KEEP:
                number = "sua".find(role[:1])
                self.state = KEPT[self.state][number]
                yield LETTERS[KEEP], role, text
                return
            needed, self.state = NEEDED[self.state], AFTER[self.state]
            if edit == REROLE:
                yield LETTERS[REROLE], needed, text
                return
            yield LETTERS[INSERT], needed, ""

    def end(self) -> Iterator[tuple[str, str, str]]:
        while self.state in (SYSTEM, USER):
            self.edits.append(ord(LETTERS[INSERT]))
            needed, self.state = NEEDED[self.state], AFTER[self.state]
            yield LETTERS[INSERT], needed, ""


def _walk(turns: DataFrame, conversations: DataFrame | None, block: int, digests: bool) -> DataFrame:
    spark = turns.sparkSession
    ready(spark)
    marked = _marked(turns)
    names = turns if conversations is None else conversations
    spilled, _ = write_table(_backpointers(marked, names, block), "backpointers")
    none = F.lit(None)
    rows = marked.withColumns({"kind": F.lit(2), "place": F.lit(0).cast("long"), "choices": none.cast("binary"),
                               "stats": none.cast("array<bigint>")})
    blocks = spilled.withColumns({"role": none.cast("string"), "text": none.cast("string")})
    stream = rows.unionByName(blocks).repartition(spread(spark), "conv").sortWithinPartitions(
        "conv", F.col("kind") != 0, F.desc("no_turn"), "turn", "digest", "kind", F.desc("place"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Repair | None = None
        digest = None
        out: list[tuple] = []
        chars = 0

        def give(found: Iterator[tuple[str, str, str]]) -> None:
            nonlocal chars
            for edit, role, text in found:
                now.n += 1
                if digests:
                    digest.update(f"\n{role}:{text}"[now.n == 1:].encode())
                else:
                    out.append((now.conv, now.n, edit, role, text))
                    chars += len(text)

        def close() -> None:
            nonlocal chars
            give(now.end())
            if digests:
                out.append((now.conv, *map(int, now.stats), now.edits.decode(), now.n, digest.hexdigest()))
                chars += len(now.edits)

        def table() -> pd.DataFrame:
            nonlocal chars
            done = pd.DataFrame(out, columns=names)
            out.clear()
            chars = 0
            return done

        names = ["conv", *STATS, "audit", "n_turns", "repaired_sha256"] if digests else ["conv", "place", "edit", "role", "text"]
        for batch in batches:
            columns = (batch[c].tolist() for c in ("conv", "kind", "role", "text", "choices", "stats"))
            for conv, kind, role, text, choices, stats in zip(*columns, strict=True):
                if kind == 0:
                    if now is not None:
                        close()
                    now, digest = Repair(conv, stats), hashlib.sha256()
                if kind < 2:
                    now.add_block(choices)
                else:
                    give(now.turn(role, text))
                if len(out) >= OUT_ROWS or chars >= OUT_CHARS:
                    yield table()
        if now is not None:
            close()
        if out:
            yield table()

    kind = dict(turns.dtypes)["conv_id"]
    if digests:
        schema = "conv string, " + ", ".join(f"{c} long" for c in STATS) + ", audit string, n_turns long, repaired_sha256 string"
    else:
        schema = "conv string, place long, edit string, role string, text string"
    out = stream.mapInPandas(scan, schema)
    return out.select(F.col("conv").cast(kind).alias("conv_id"), *[c for c in out.columns if c != "conv"])


def repaired_turns(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``conv_id, place, edit, role, text``: the turns of every repaired conversation, ``place`` from 1."""
    return _walk(turns, conversations, block, digests=False)


def repair_report(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``turns`` (or of ``conversations``): ``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, n_turns, repaired_sha256``; ``audit`` has the letter of every edit in order."""
    return _walk(turns, conversations, block, digests=True)


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2
    removes its ``.!?``, 3 repeats it, 4 makes its role user.  Nulls are one space."""
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("__fault")).where("__fault <> 0")
    changed = rows.select(
        "conv_id", "turn", F.when(F.col("__fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("__fault") == 1, "").when(F.col("__fault") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("__fault") == 3, 2).otherwise(1).alias("__times"))
    return changed.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "__times"))).drop("col")
