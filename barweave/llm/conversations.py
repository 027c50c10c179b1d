"""Repairs the structure of conversations: the cheapest edits after which speakers alternate, found by A*.

A node of the lattice is a number of rows taken and what the rows kept so far end with. Rows that must go cost their
deletion on every path, and rows that end in mid-sentence cost a deletion or the charge for staying, whichever is less;
the sum over the rows not yet taken is a bound from below, and the search's heuristic. The queue is ordered by cost plus
heuristic, then by the edits so far, so that the first path to the end is the cheapest and, of these, the first by name.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, partitions, releasing

#: Costs of the edits, and of a row that stays though it ends in mid-sentence.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
BLANKS = " \t\n\x0b\f\r"
#: What kept rows end with: nothing, a system row, a user row, an assistant row. An end is either nothing or an assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = ("su", "ua", "au")
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)


class Edits:
    """The edits up to a node, as a chain: compared as strings are, in time logarithmic in their number.

    Children of a chain differ in their letters, so two chains compare by the letters after the longest that they share.
    """

    __slots__ = ("up", "far", "n", "letter")

    def __init__(self, up: Edits | None = None, letter: str = ""):
        self.up, self.letter, self.n = up, letter, up.n + 1 if up else 0
        if up is None:
            self.far = self
        else:  # jumps double as they join, as in a skew binary number
            self.far = up.far.far if up.n - up.far.n == up.far.n - up.far.far.n else up

    def at(self, n: int) -> Edits:
        here = self
        while here.n > n:
            here = here.far if here.far.n >= n else here.up
        return here

    def __lt__(self, other: Edits) -> bool:
        n = min(self.n, other.n)
        a, b = self.at(n), other.at(n)
        if a is b:
            return self.n < other.n
        while a.up is not b.up:
            a, b = (a.far, b.far) if a.far is not b.far else (a.up, b.up)
        return a.letter < b.letter

    def __str__(self) -> str:
        out, here = [], self
        while here.up:
            out.append(here.letter)
            here = here.up
        return "".join(reversed(out))


def _speaks(initial: str, last: int) -> int | None:
    """What kept rows end with after one of that initial, if it may stand there."""
    if initial == "s":
        return SYSTEM if last == NONE else None
    if initial == "u":
        return USER if last != USER else None
    return ASSISTANT if initial == "a" and last == USER else None


def cheapest(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """The cost of the cheapest edits and their letters: (D)elete, (I)nsert, (K)eep, (R)erole."""
    n = len(initials)
    ahead = [0] * (n + 1)  # what the rows from here on cost at least
    for i in reversed(range(n)):
        ahead[i] = ahead[i + 1] + (DELETE if faults[i] in (BLANK, DUPLICATE) else min(DELETE, CUT) if faults[i] == TRUNCATED else 0)
    queue, done = [(ahead[0], Edits(), 0, NONE)], bytearray(4 * (n + 1))
    while True:
        f, edits, i, last = heapq.heappop(queue)
        if done[4 * i + last]:
            continue
        done[4 * i + last] = 1
        if i == n and last in (NONE, ASSISTANT):
            return f, str(edits)
        cost, turn = f - ahead[i], ASSISTANT if last == USER else USER

        def go(letter, price, i, last):
            if not done[4 * i + last]:
                heapq.heappush(queue, (cost + price + ahead[i], Edits(edits, letter), i, last))

        go("I", INSERT, i, turn)
        if i < n:
            go("D", DELETE, i + 1, last)
            if faults[i] not in (BLANK, DUPLICATE):
                stays = CUT if faults[i] == TRUNCATED else 0
                kept = _speaks(initials[i], last)
                if kept is not None:
                    go("K", stays, i + 1, kept)
                go("R", REROLE + stays, i + 1, turn)


def damage(rows: DataFrame) -> DataFrame:
    """The rows of a table of conversations with known damage, by a hash of conversation and turn; nulls are read as a blank.

    Of 20 rows one is dropped, one emptied, one loses its ends of sentences, one is repeated (``copy`` is 1 for the second)
    and one is given to the user. ``conv_id`` and ``turn`` stay as they are.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copy = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), copy.alias("copy"))


def _stripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


#: The order of a conversation's rows: equal turns by role, then by a digest of the text.
ORDER = ("turn", "role", "digest", "copy")


def repair(rows: DataFrame, every: DataFrame) -> DataFrame:
    """What is wrong with each conversation of ``every`` (conv_id), and the cheapest way to set it right.

    rows: (conv_id, turn, role, text, copy), in a conversation by turn with nulls first; rows of one turn go by role and
    digest of text. The result is (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), as
    long and string columns: turns missing between the first and the last, rows by their first fault, neighbours that may
    not follow each other, the least cost, its edits, and the digest of the repaired rows. The edits leave nothing, or one
    system row at most and then user and assistant in turn. A conversation without rows has zeros, no edits and the digest
    of nothing; a null conv_id is a conversation, and repeated rows of a conversation are duplicates. An empty table has
    no rows.

    Tasks read a conversation as a stream, in order. The search sees one letter a row; texts pass by one at a time.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "conversations")
    last = F.substring(_stripped(F.col("text")), -1, 1)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(CLEAN)
    # The key of a group: null ids stay together and apart from others.
    key = F.to_json(F.struct(F.col("conv_id").cast("string").alias("id")))
    rows = scratch.save(rows.select("conv_id", key.alias("key"), "turn", "role", "text", "copy", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), fault.alias("fault")), "rows")
    numbers = _searched(rows, partitions(spark))
    numbers = scratch.save(numbers, "numbers")
    hashes = _hashed(rows, numbers, partitions(spark))
    found = scratch.save(numbers.join(hashes, "key"), "found")
    own = every.select("conv_id").distinct().withColumn("key", key)
    out = own.join(found, "key", "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _searched(rows: DataFrame, n: int) -> DataFrame:
    names = ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches):
        key, seen, initials, faults, turns = None, set(), [], [], [None, None, 0, None]

        def end():
            low, high, distinct, _ = turns
            pairs = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            return (key, high - low + 1 - distinct if distinct else 0, *(faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)), pairs, *cheapest(initials, faults))

        for batch in batches:
            out = []
            for k, turn, role, digest, fault in zip(*(batch.column(c).to_pylist() for c in ("key", "turn", "role", "digest", "fault")), strict=True):
                if k != key:
                    if key is not None:
                        out.append(end())
                    key, seen, initials, faults, turns = k, set(), [], [], [None, None, 0, None]
                own = role, digest
                faults.append(DUPLICATE if fault != BLANK and own in seen else fault)
                seen.add(own)
                initials.append(role[:1])
                if turn is not None:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + (turn != turns[3]), turn]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(end(), strict=True)], names=names)

    ordered = rows.select("key", *ORDER, "fault").repartition(n, "key").sortWithinPartitions("key", *ORDER)
    return ordered.mapInArrow(releasing(run), "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _hashed(rows: DataFrame, edits: DataFrame, n: int) -> DataFrame:
    """(key, repaired_sha256): each conversation's edits come before its rows, whose texts are hashed as they pass by."""

    def run(batches):
        key, audit, at, turn, first, sha = None, "", 0, "user", True, hashlib.sha256()

        def say(role, text):
            nonlocal first, turn
            sha.update((b"" if first else b"\n") + role.encode() + b":" + text)
            first, turn = False, "assistant" if role[:1] == "u" else "user"

        def inserts():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                say(turn, b"")
                at += 1

        out = []

        def end():
            inserts()
            out.append((key, sha.hexdigest()))

        for batch in batches:
            for k, a, role, text in zip(*(batch.column(c) for c in ("key", "audit", "role", "text")), strict=True):
                if a.is_valid:
                    if key is not None:
                        end()
                    key, audit, at, turn, first, sha = k.as_py(), a.as_py(), 0, "user", True, hashlib.sha256()
                    continue
                inserts()
                letter, at = audit[at], at + 1
                if letter != "D":
                    say(role.as_py() if letter == "K" else turn, text.as_py())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], names=["key", "repaired_sha256"])
                out.clear()
        if key is not None:
            end()
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], names=["key", "repaired_sha256"])

    rows = rows.withColumn("text", F.col("text").cast("binary"))
    null = {c: F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in (*ORDER, "text")}
    heads = edits.select("key", F.lit(0).alias("part"), "audit", *(null[c] for c in (*ORDER, "text")))
    lines = rows.select("key", F.lit(1).alias("part"), F.lit(None).cast("string").alias("audit"), *ORDER, "text")
    ordered = heads.union(lines).repartition(n, "key").sortWithinPartitions("key", "part", *ORDER)
    return ordered.select("key", "audit", "role", "text").mapInArrow(releasing(run), "key string, repaired_sha256 string")
