"""Repair of conversations: a forward Viterbi pass over four grammar states for each conversation.

The rows of a conversation are judged first, by windows: blank (no character but white space), duplicate (role and text seen
earlier) or truncated (its last such character is none of ``.!?``); the first fault counts. Then its rows stream through
a dynamic programme over the states start, system, user and assistant. Each state carries the least (cost, audit string) with which the
rows so far reach it; a row is kept, given the role the grammar wants next, or deleted, and each layer is closed by at most two
insertions, as two lead from any state to any other that the grammar can reach. The role initials of the result are
``(s?(ua)+)?``. Among repairs of one cost the least audit string wins; that is safe state by state, as no audit
string of a state and cost can be the beginning of another one (the difference would be insertions, which cost).

The rows of an id arrive in one partition, sorted by turn (nulls first), then role and text, and are never held together: the
conversation at hand is spooled, to the worker's disk beyond ``SPOOL`` bytes, until its last row decides. What memory grows
with a conversation is its audit string, a letter for each row, once for each state.

Edge cases: a null role or text counts as one space, and so does a null id or turn in the key of the damage. A null id is one
conversation. A conversation whose rows are all dropped has zeros, an empty audit and the hash of the empty text. Rows that repeat are duplicates.
An empty table gives an empty result. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, table, utf8

KEEP, REROLE, DELETE, INSERT, UNENDED = 0, 3, 4, 3, 3
#: Bytes of a conversation that a worker holds in memory.
SPOOL = 8 << 20
#: Repaired turns that a worker hands on at a time, by their characters.
OUT_CHARS = 1 << 22
SPACE = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that is wanted in a state, other than system.
WANTED = ("user", "user", "assistant", "user")
NEXT = tuple(AFTER[s, WANTED[s][0]] for s in range(4))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``there`` of each row after the damage; a dropped row stays with ``there`` false, so that its conversation does."""
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    base = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return base.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), copies.alias("copy")).drop("copy")


def judged(rows: DataFrame) -> DataFrame:
    """Rows with their ``fault``: b, d, t or nothing. All rows of an id are in one partition, sorted."""
    order = [F.asc_nulls_first("turn"), "role", "text"]
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(*order)
    there = F.col("there").cast("int")
    seen = rows.repartition("conv_id").withColumn("digest", F.sha2("text", 256)).withColumn("before", F.sum(there).over(same.rowsBetween(Window.unboundedPreceding, -1)))
    end = F.rtrim("text", F.lit(SPACE))
    fault = F.when(end == "", "b").when(F.col("before") > 0, "d").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    return seen.select("conv_id", "turn", "role", "text", "there", fault.alias("fault")).sortWithinPartitions("conv_id", *order)


def closed(layer: list[tuple[int, str] | None]) -> list[tuple[int, str] | None]:
    """A layer with at most two insertions after each state."""
    for _ in range(2):
        better = list(layer)
        for state, best in enumerate(layer):
            if best is not None:
                found = (best[0] + INSERT, best[1] + "I")
                if better[NEXT[state]] is None or found < better[NEXT[state]]:
                    better[NEXT[state]] = found
        layer = better
    return layer


def advanced(layer: list[tuple[int, str] | None], initial: str, fault: str) -> list[tuple[int, str] | None]:
    """The layer after one more row."""
    out: list[tuple[int, str] | None] = [None] * 4
    toll = UNENDED if fault == "t" else 0
    for state, best in enumerate(layer):
        if best is None:
            continue
        found = [(state, (best[0] + DELETE, best[1] + "D"))]
        if fault not in ("b", "d"):
            found.append((NEXT[state], (best[0] + REROLE + toll, best[1] + "R")))
            if (state, initial) in AFTER:
                found.append((AFTER[state, initial], (best[0] + KEEP + toll, best[1] + "K")))
        for after, value in found:
            if out[after] is None or value < out[after]:
                out[after] = value
    return closed(out)


class Conversation:
    """One conversation's rows as they stream by."""

    def __init__(self, own: str | None) -> None:
        self.own, self.layer = own, closed([(0, ""), None, None, None])
        self.rows = tempfile.SpooledTemporaryFile(max_size=SPOOL)
        self.faults = {"b": 0, "d": 0, "t": 0, "": 0}
        self.first = self.last = self.initial = None
        self.turns = self.illegal = 0

    def add(self, turn: str | None, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = self.first if self.turns else turn, turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self.faults[fault] += 1
        self.layer = advanced(self.layer, role[:1], fault)
        pickle.dump((role, text), self.rows)

    def best(self) -> tuple[int, str]:
        return min(x for x in (self.layer[START], self.layer[ASSISTANT]) if x is not None)

    def repaired(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of each turn of the result."""
        self.rows.seek(0)
        state = START
        for edit in self.best()[1]:
            role, text = ("", "") if edit == "I" else pickle.load(self.rows)
            if edit == "D":
                continue
            role, state = (role, AFTER[state, role[:1]]) if edit == "K" else (WANTED[state], NEXT[state])
            yield edit, role, text

    def summary(self) -> tuple:
        """The counts, the cost, the audit and the hash of the repaired turns."""
        digest, between = hashlib.sha256(), b""
        for _, role, text in self.repaired():
            digest.update(between + utf8(f"{role}:{text}"))
            between = b"\n"
        gaps = int(self.last) - int(self.first) + 1 - self.turns if self.turns else 0
        return (self.own, gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, *self.best(), digest.hexdigest())


def conversations(batches: Iterator[pd.DataFrame]) -> Iterator[Conversation]:
    """The conversations of sorted rows, each when its last row has passed."""
    at = None
    for batch in batches:
        for own, turn, role, text, there, fault in zip(*(batch[c] for c in ("conv_id", "turn", "role", "text", "there", "fault")), strict=True):
            if at is None or own != at.own:
                if at is not None:
                    yield at
                    at.rows.close()
                at = Conversation(own)
            if there:
                at.add(turn, role, text, fault)
    if at is not None:
        yield at
        at.rows.close()


def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns, out = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"], []
    for x in conversations(batches):
        out.append(x.summary())
        if len(out) == 1000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    yield pd.DataFrame(out, columns=columns)


def turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns, out, held = ["conv_id", "place", "edit", "role", "text"], [], 0
    for x in conversations(batches):
        for place, (edit, role, text) in enumerate(x.repaired()):
            out.append((x.own, place, edit, role, text))
            held += len(text) + 64
            if held > OUT_CHARS:
                yield pd.DataFrame(out, columns=columns)
                out, held = [], 0
    yield pd.DataFrame(out, columns=columns)


def _streamed(rows: DataFrame, function, schema: str) -> DataFrame:
    kind = rows.schema["conv_id"].dataType
    spelled = judged(rows).select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "there", "fault")
    out = map_batches(spelled, function, f"conv_id string, {schema}")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def repair_summaries(rows: DataFrame) -> DataFrame:
    """One row for each conversation: gaps, faults, cost, audit and the hash of its repaired turns. ``rows`` as ``damaged`` gives them."""
    return _streamed(rows, summaries, "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The turns of all repaired conversations: conv_id, place, edit (K, R or I), role, text."""
    return _streamed(rows, turns, "place bigint, edit string, role string, text string")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_summaries(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def _sql() -> str:
    """The same by a recursive query: a state is a text of cost (9 digits), audit, character 1 and the repaired lines, so the least text is the best repair."""

    def edit(x: str, cost: str, letter: str, line: str = "''") -> str:
        mark = f"position(chr(1) IN {x})"
        return f"(lpad((substr({x}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({x}, 10, {mark} - 10) || '{letter}' || substr({x}, {mark}) || {line})"

    keep = lambda s, i: f"CASE WHEN ok AND initial = '{i}' THEN {edit(s, 'toll', 'K', 'line')} END"
    rerole = lambda s, r: f"CASE WHEN ok THEN {edit(s, '3 + toll', 'R', chr(39) + r + ':' + chr(39) + ' || text || chr(10)')} END"
    insert = lambda s, r: edit(s, "3", "I", f"'{r}:' || chr(10)")
    delete = lambda s: edit(s, "4", "D")
    return f"""
        WITH RECURSIVE steps AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ), spelled AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS letters FROM conversations
        ), kinds AS (
            SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(letters, lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
            FROM spelled, steps
        ), damaged AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM kinds, range(2) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ending FROM damaged
        ), judged AS (
            SELECT *, CASE WHEN ending = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd' WHEN right(ending, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                   substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before
            FROM placed
        ), coded AS (
            SELECT conv_id, n, initial, text, role || ':' || text || chr(10) AS line, fault NOT IN ('b', 'd') AS ok, CASE fault WHEN 't' THEN 3 ELSE 0 END AS toll FROM judged
        ), counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                   count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
            FROM judged GROUP BY conv_id
        ), walk AS (
            SELECT conv_id, 0::BIGINT AS n, '000000000' || chr(1) AS s0, NULL::VARCHAR AS s1, '000000003I' || chr(1) || 'user:' || chr(10) AS s2,
                   '000000006II' || chr(1) || 'user:' || chr(10) || 'assistant:' || chr(10) AS s3
            FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, n, c0, c1, least(u, {insert("a", "user")}), least(a, {insert("u", "assistant")})
            FROM (
                SELECT conv_id, n, c0, c1, least(c2, {insert("c0", "user")}, {insert("c1", "user")}, {insert("c3", "user")}) AS u, least(c3, {insert("c2", "assistant")}) AS a
                FROM (
                    SELECT walk.conv_id, coded.n, {delete("s0")} AS c0, least({delete("s1")}, {keep("s0", "s")}) AS c1,
                           least({delete("s2")}, {", ".join(keep(s, "u") for s in ("s0", "s1", "s3"))}, {", ".join(rerole(s, "user") for s in ("s0", "s1", "s3"))}) AS c2,
                           least({delete("s3")}, {keep("s2", "a")}, {rerole("s2", "assistant")}) AS c3
                    FROM walk JOIN coded ON walk.conv_id IS NOT DISTINCT FROM coded.conv_id AND coded.n = walk.n + 1
                )
            )
        ), ended AS (
            SELECT walk.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, least(s0, s3) AS best
            FROM walk LEFT JOIN counted ON walk.conv_id IS NOT DISTINCT FROM counted.conv_id WHERE walk.n = coalesce(counted.n, 0)
        )
        SELECT conv_id, gaps, blank, duplicate, truncated, illegal, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10, position(chr(1) IN best) - 10) AS audit,
               sha256(substr(best, position(chr(1) IN best) + 1)[:-2]) AS repaired_sha256
        FROM ended
    """


SQL = {"op12_repair": _sql()}
QUERIES = {"op12_repair": op12_repair}
