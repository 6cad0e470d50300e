"""Repair of the role structure of conversations by depth-first branch-and-bound.

A conversation is well formed if the initials of its roles are ``(s?(ua)+)?``: at most one system turn, then user and assistant in
turn.  Blank and repeated turns have to go; any other turn may be kept, deleted or given another role, and empty turns may be
inserted.  The cheapest edits win, among equal costs those whose initials (D, I, K, R) are ASCII-least.

The search for one conversation keeps an explicit stack.  A node is (turns done, state of the pattern).  ``suffix_bounds`` gives each
node a cost that no completion can go below: the cheapest way to bring the remaining turns into the pattern, which may stop anywhere.  The
incumbent is a (cost, audit): the first one comes from a dive along the bounds; then branches are tried in ASCII order, so that of
two prefixes with one cost the later one is the greater.  A table per node keeps the lowest cost at which it was entered, and a
prefix that is not cheaper is worse and goes.  As the bound is short of the truth by at most one insert, a node is entered
again at most that many times, and the search is linear in the turns.

No task holds the texts of a conversation.  Each turn travels twice: as a few bytes (role, fault) that sort before all texts of its
conversation, and with its text.  A task streams over its sorted rows, decides when the texts begin, and hashes them as they pass,
so memory is some bytes per turn of the current conversation, however long its texts are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.llm.common import BLANK, BLANKS, query, table

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3  # costs; CUT is added where a truncated turn is not deleted
SOUND, BLANK_TURN, REPEATED, TRUNCATED = range(4)

# states of the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {("s", _START): _SYSTEM, ("u", _START): _USER, ("u", _SYSTEM): _USER, ("a", _USER): _ASSISTANT, ("u", _ASSISTANT): _USER}
_WANTED = {_START: "u", _SYSTEM: "u", _USER: "a", _ASSISTANT: "u"}  # what a new or changed role must be
_DONE = (_START, _ASSISTANT)
_LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}


def _kept(initial: str, state: int) -> int | None:
    """The state after a kept turn, None where the pattern forbids it.  A role without letters leaves no initial."""
    return state if initial == "" else _NEXT.get((initial, state))


def _move(state: int) -> int:
    return _NEXT[_WANTED[state], state]


def suffix_bounds(initials: list[str], faults: bytes | list[int]) -> list[tuple[int, ...]]:
    """Per number of turns done and state: the least cost of the remaining turns if the pattern may stop anywhere."""
    bounds = [(0, 0, 0, 0)]
    for initial, fault in zip(reversed(initials), reversed(faults)):
        after, here = bounds[-1], []
        for state in range(4):
            cost = DELETE + after[state]
            if fault not in (BLANK_TURN, REPEATED):
                extra = CUT if fault == TRUNCATED else 0
                cost = min(cost, REROLE + extra + after[_move(state)])
                to = _kept(initial, state)
                if to is not None:
                    cost = min(cost, extra + after[to])
            here.append(cost)
        for _ in range(2):  # up to two turns inserted before this one
            here = [min(c, INSERT + here[_move(state)]) for state, c in enumerate(here)]
        bounds.append(tuple(here))
    bounds.reverse()
    return bounds


def repair(initials: list[str], faults: bytes | list[int]) -> tuple[int, str]:
    """The least cost and, among its solutions, the ASCII-least string of edits."""
    n = len(initials)
    bounds = suffix_bounds(initials, faults)

    def branches(done: int, state: int) -> list[tuple[str, int, int, int]]:
        """(edit, cost, turns done, state) of every edit, in ASCII order."""
        out = []
        if done < n:
            out.append(("D", DELETE, done + 1, state))
        out.append(("I", INSERT, done, _move(state)))
        if done < n and faults[done] not in (BLANK_TURN, REPEATED):
            extra = CUT if faults[done] == TRUNCATED else 0
            to = _kept(initials[done], state)
            if to is not None:
                out.append(("K", extra, done + 1, to))
            out.append(("R", REROLE + extra, done + 1, _move(state)))
        return out

    # the first incumbent: always the branch with the lowest bound
    cost, done, state, edits = 0, 0, _START, []
    while done < n or state not in _DONE:
        edit, price, done, state = min(branches(done, state), key=lambda b: (b[1] + bounds[b[2]][b[3]], b[0] == "I"))
        cost += price
        edits.append(edit)
    best, audit, found = cost, "".join(edits), False

    entered = {(0, _START): 0}  # per node, the lowest cost so far
    path: list[str] = []
    stack = [(0, 0, _START, 0, "")]  # cost, turns done, state, length of the path before, edit
    while stack:
        cost, done, state, length, edit = stack.pop()
        bound = cost + bounds[done][state]
        if bound > best or (found and bound == best) or (edit and entered.get((done, state), cost + 1) <= cost):
            continue
        entered[done, state] = cost
        del path[length:]
        if edit:
            path.append(edit)
        if done == n and state in _DONE:
            best, audit = min((best, audit), (cost, "".join(path)))
            found = True  # from now on, only what is cheaper can win
        at = len(path)
        for e, price, to_done, to_state in reversed(branches(done, state)):
            stack.append((cost + price, to_done, to_state, at, e))
    return best, audit


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The rows after the fixed damage of ``op11``, with ``copy`` (0, 1 for a repeated row) and ``gone`` (a dropped row).

    By the crc32 of ``id:turn`` (a null as one space) modulo 20: 0 drops the row, 1 empties its text, 2 removes its final marks,
    3 repeats it, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part(id_col), F.lit(":"), part(turn_col)).cast("binary")) % 20
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    found = rows.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return found


def with_faults(rows: DataFrame) -> DataFrame:
    """Each turn (conv_id, turn, role, copy, gone) with a digest of role and text and its first fault, without its text.

    Turns are ordered by ``turn`` (nulls first), then digest and copy.  The first turn of each digest is found with the rows dealt by
    (conversation, digest), so a long conversation is not one task here.
    """
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    narrow = rows.select(
        "conv_id", "turn", "role", "copy", "gone",
        F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("digest"),
        (~F.col("text").rlike(BLANK.replace("[", "[^"))).alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"),
    )
    seen = W.partitionBy("conv_id", "digest", "gone").orderBy(F.asc_nulls_first("turn"), "copy")
    fault = (
        F.when(F.col("blank"), BLANK_TURN).when(F.row_number().over(seen) > 1, REPEATED).when(F.col("cut"), TRUNCATED).otherwise(SOUND)
    )
    return narrow.withColumn("fault", fault).drop("blank", "cut")


class _Conversation:
    """What is known of the conversation that a task is passing."""

    def __init__(self, key):
        self.key = key
        self.initials: list[str] = []
        self.faults = bytearray()
        self.first = self.last = None
        self.turns = 0
        self.illegal = 0
        self.plan: Iterator[str] | None = None
        self.cost, self.audit = 0, ""
        self.hash, self.empty = hashlib.sha256(), True
        self.state = _START

    def add(self, turn: int | None, role: str, fault: int):
        if turn is not None:
            if self.first is None:
                self.first = turn
            if turn != self.last:
                self.turns += 1
            self.last = turn
        initial = role[:1]
        if self.initials and self.initials[-1] + initial not in _LEGAL:
            self.illegal += 1
        self.initials.append(initial)
        self.faults.append(fault)

    def decide(self):
        self.cost, self.audit = repair(self.initials, self.faults)
        self.plan = iter(self.audit)

    def _put(self, role: str, text: str):
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def _edit(self, e: str, role: str, text: str) -> bool:
        """Apply one edit; true if it used up the turn."""
        if e == "K":
            self._put(role, text)
            self.state = _kept(role[:1], self.state)
        elif e != "D":
            self._put(ROLES[_WANTED[self.state]], text if e == "R" else "")
            self.state = _move(self.state)
        return e != "I"

    def text(self, role: str, text: str):
        if self.plan is None:
            self.decide()
        while not self._edit(next(self.plan), role, text):
            pass

    def row(self) -> tuple:
        if self.plan is None:
            self.decide()
        for e in self.plan:  # what is inserted at the end
            self._edit(e, "", "")
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        count = self.faults.count
        faults = (count(BLANK_TURN), count(REPEATED), count(TRUNCATED))
        return (self.key, gaps, *faults, self.illegal, self.cost, self.audit, self.hash.hexdigest())


_COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current: _Conversation | None = None
    key_type = None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        types = [key_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(_COLUMNS))

    for batch in batches:
        key_type, out = batch.schema.field(0).type, []
        for key, turn, role, text, fault, gone in zip(*[batch.column(i).to_pylist() for i in range(6)]):
            if current is None or key != current.key:
                if current is not None:
                    out.append(current.row())
                current = _Conversation(key)
            if gone:
                continue
            if text is None:
                current.add(turn, role, fault)
            else:
                current.text(role, text)
        if out:
            yield packed(out)
    if current is not None:
        yield packed([current.row()])


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, copy, gone): its faults, the least cost, the edits and the
    SHA-256 of the repaired ``role:text`` lines.

    ``copy`` numbers equal rows, ``gone`` marks rows that only say that their conversation exists.  A null id is a conversation
    of its own; null turns come first; turns with one number go by the digest of role and text.  A conversation without turns costs nothing, has an
    empty audit and the hash of the empty string.  Roles count by their first letter, in lower case only.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = with_faults(rows).select("conv_id", "turn", "role", F.lit(None).cast("string").alias("text"), "fault", "gone", "digest", "copy", F.lit(0).alias("part"))
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    full = rows.filter(~F.col("gone")).select("conv_id", "turn", "role", "text", F.lit(None).cast("int").alias("fault"), "gone", digest.alias("digest"), "copy", F.lit(1).alias("part"))
    dealt = narrow.unionByName(full).repartition(partitions, "conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "digest", "copy")
    key = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return ordered.select("conv_id", "turn", "role", "text", "fault", "gone").mapInArrow(_stream, schema)


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))
