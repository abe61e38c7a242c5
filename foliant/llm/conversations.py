"""Repair of conversations by a forward Viterbi pass over a grammar of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

#: States of the grammar (s?(ua)+)? : nothing yet, a system turn, a user turn open, an assistant turn closes it.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a state may go on with, by role initial.
MOVES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The one role a turn may be given in a state, and the state after it.
GIVEN = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
ACCEPT = (START, ASSISTANT)
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
SPACE = " \t\n\x0b\f\r"
#: Edits that a survivor's audit holds as one string before it is laid down as a piece.
PIECE = 256
LEGAL = {"su", "ua", "au"}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)


class Path:
    """A surviving sequence of edits: its cost, its audit string, and the digest of the turns it keeps.

    The audit is a chain of laid-down pieces, their order among the survivors (``rank``) and a short open end, so a
    conversation of any length costs constant time a turn. Audits that consumed the same turns and end in the edit of
    one are never proper prefixes of each other (an insert more would cost more), so comparing ranks, then open ends,
    compares the strings, and the least one stays the least whatever follows.
    """

    __slots__ = ("cost", "rank", "end", "chain", "sha")

    def __init__(self, cost: int, rank: int, end: str, chain, sha):
        self.cost, self.rank, self.end, self.chain, self.sha = cost, rank, end, chain, sha

    def audit(self) -> str:
        parts, chain = [self.end], self.chain
        while chain is not None:
            chain, piece = chain
            parts.append(piece)
        return "".join(reversed(parts))

    def digest(self, role: str | None, text: str):
        """This path's digest with one more turn; a path's own digest never changes."""
        if role is None:
            return self.sha
        sha = self.sha.copy() if self.sha is not None else hashlib.sha256()
        sha.update((("\n" if self.sha is not None else "") + role + ":" + text).encode("utf-8", "replace"))
        return sha


def better(a: tuple, b: tuple | None) -> bool:
    return b is None or a[:3] < b[:3]


def closed(layer: list[Path | None]) -> list[Path | None]:
    """The layer after inserted empty turns. Two are enough: from any state they reach every state that has an insert."""
    out = list(layer)
    for _ in range(2):
        for state in range(4):
            path = out[state]
            if path is None:
                continue
            role, to = GIVEN[state]
            there = out[to]
            if there is None or (path.cost + INSERT, path.rank, path.end + "I") < (there.cost, there.rank, there.end):
                out[to] = Path(path.cost + INSERT, path.rank, path.end + "I", path.chain, path.digest(role, ""))
    return out


def advanced(layer: list[Path | None], fault: int, role: str, text: str) -> list[Path | None]:
    """The layer after one more turn is kept, given another role or deleted, before inserts."""
    best: list[tuple | None] = [None] * 4
    more = CUT_SHORT if fault == TRUNCATED else 0
    for state, path in enumerate(layer):
        if path is None:
            continue
        options = [(state, DELETE, "D", None)]
        if fault in (SOUND, TRUNCATED):
            to = MOVES[state].get(role[:1])
            if to is not None:
                options.append((to, more, "K", role))
            given, to = GIVEN[state]
            options.append((to, REROLE + more, "R", given))
        for to, cost, edit, name in options:
            found = (path.cost + cost, path.rank, path.end + edit, path, name)
            if better(found, best[to]):
                best[to] = found
    out = [None if b is None else Path(b[0], b[1], b[2], b[3].chain, b[3].digest(b[4], text)) for b in best]
    # nothing-yet and after-system end no better than after-assistant: once they cost more they can never win again
    done = out[ASSISTANT]
    if done is not None and out[START] is not None and out[START].cost > done.cost + DELETE:
        out[START] = None
    if done is not None and out[SYSTEM] is not None and out[SYSTEM].cost > done.cost:
        out[SYSTEM] = None
    if any(p is not None and len(p.end) >= PIECE for p in out):
        alive = sorted((p for p in out if p is not None), key=lambda p: (p.rank, p.end))
        for rank, p in enumerate(alive):
            p.rank, p.end, p.chain = rank, "", (p.chain, p.end)
    return out


class Repair:
    """One conversation, turn by turn."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.layer = closed([Path(0, 0, "", None, None), None, None, None])
        self.counts = [0, 0, 0, 0]
        self.illegal = self.rows = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.rows += 1
        self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        self.layer = closed(advanced(self.layer, fault, role, text))

    def result(self) -> dict:
        path = min((self.layer[s] for s in ACCEPT if self.layer[s] is not None), key=lambda p: (p.cost, p.rank, p.end))
        audit = path.audit() if self.rows else ""
        return {
            "conv_id": self.conv_id, "gaps": 0 if self.first is None else self.last - self.first + 1 - self.turns,
            "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[TRUNCATED],
            "illegal": self.illegal, "cost": path.cost, "audit": audit,
            "repaired_sha256": (path.sha or hashlib.sha256()).hexdigest(), "n_rows": self.rows,
        }


def faults(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text, gone)`` in order within its conversation, with the first fault of each row.

    One shuffle by conversation serves all: the window over (conversation, role, text) and both sorts are local. Equal
    turns are ordered by role, then text, so any input order gives the same result.
    """
    bare = F.rtrim("text", F.lit(SPACE))
    seen = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    fault = (
        F.when(bare == "", BLANK).when(F.row_number().over(seen) > 1, DUPLICATE)
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND))
    spread = turns.repartition("conv_id").select("conv_id", "turn", "role", "text", "gone", fault.cast("int").alias("fault"))
    return spread.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def _turns(convs: DataFrame, gone: Column | None) -> DataFrame:
    return convs.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"))


_FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long"


def _schema(df: DataFrame, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", df.schema["conv_id"].dataType), *T.StructType.fromDDL(rest).fields])


def _rows(batches, columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield from zip(*(part.column(c).to_pylist() for c in columns))


def plans(convs: DataFrame, gone: Column | None = None) -> DataFrame:
    """The cheapest repair of each conversation: one row per distinct conv_id of ``convs(conv_id, turn, role, text, ...)``.

    A forward Viterbi pass over four grammar states carries the least (cost, audit string) of each; every turn's layer is
    closed by at most two inserts. ``audit`` has one initial per edit (Keep, Rerole, Delete, Insert), ``cost`` its cost,
    ``repaired_sha256`` the digest of the repaired ``role:text`` lines, beside counts of gaps, first faults, illegal pairs of
    neighbours and ``n_rows``. Rows for which ``gone`` holds are not there, but their conversation is returned.

    The digest of a conversation runs over all its texts in order, so its rows come to one task, which must read them
    as a sorted stream: Spark spills the sort, and the task holds four survivors and their audits, never the rows.

    Null roles and texts are one space (so such a text is blank); an empty role can't be kept; null turns come first and count for no gap; rows without
    a conv_id are one conversation; equal turns are taken by role and text; an empty table gives no rows; a conversation
    without rows has zeros, an empty audit and the digest of nothing. Other columns are ignored.
    """
    turns = _turns(convs, gone)
    names = T.StructType.fromDDL(_FIELDS).names

    def work(batches):
        import pyarrow as pa

        done, now = [], None

        def full():
            return pa.RecordBatch.from_pydict({k: pa.array([d[k] for d in done], t) for k, t in types.items()})

        types = {"conv_id": None} | {k: pa.string() if k in ("audit", "repaired_sha256") else pa.int64() for k in names}
        for conv_id, turn, role, text, away, fault in _rows(batches, ["conv_id", "turn", "role", "text", "gone", "fault"]):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.result())
                    if len(done) >= 1000 or len(done[-1]["audit"]) > 1_000_000:
                        yield full()
                        done = []
                now = Repair(conv_id)
            if not away:
                now.add(turn, role, text, fault)
        if now is not None:
            done.append(now.result())
        if done:
            yield full()

    ordered = faults(turns)
    schema = _schema(ordered, _FIELDS)

    def typed(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in work(batches):
            yield batch.cast(target)

    return ordered.mapInArrow(typed, schema)


def repaired(convs: DataFrame, gone: Column | None = None) -> DataFrame:
    """The repaired turns: ``conv_id, place, turn, role, text, edit``, place from 0, edit K, R or I; odd rows as in ``plans``.

    The audit of each conversation is sorted before its turns and applied to their stream, so nothing is joined.
    """
    turns = _turns(convs, gone).where("NOT gone")
    audits = plans(convs, gone).select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("part"))
    both = audits.unionByName(turns.select("conv_id", "turn", "role", "text", F.lit(1).alias("part"))).repartition("conv_id")
    ordered = both.sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "text")
    schema = _schema(ordered, "place long, turn long, role string, text string, edit string")

    def work(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, out, size = to_arrow_schema(schema), [], 0
        audit, at, place, state, conv = "", 0, 0, START, None
        for conv_id, turn, role, text, part in _rows(batches, ["conv_id", "turn", "role", "text", "part"]):
            if part == 0:
                audit, at, place, state, conv = text, 0, 0, START, conv_id
            else:
                edit, at = audit[at], at + 1
                if edit != "D":
                    name = GIVEN[state][0] if edit == "R" else role
                    state = MOVES[state][name[:1]]
                    out.append((conv, place, turn, name, text, edit))
                    place, size = place + 1, size + len(text)
            while at < len(audit) and audit[at] == "I":
                name, state = GIVEN[state]
                out.append((conv, place, None, name, "", "I"))
                place, at = place + 1, at + 1
            if len(out) >= 1000 or size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), target)], schema=target)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), target)], schema=target)

    return ordered.mapInArrow(work, schema)


def damaged(convs: DataFrame) -> DataFrame:
    """The stated damage, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (flag ``gone``), 1 empties its text, 2 takes
    its ``[.!?]``, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = convs.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged as stated, then repaired."""
    found = damaged(table(spark, sf_dir, "conversations"))
    return plans(found, F.col("gone")).select("conv_id", *(n for n in T.StructType.fromDDL(_FIELDS).names if n != "n_rows"))


#: CRC-32 (reversed polynomial 0xEDB88320) of a text's UTF-8 bytes, as DuckDB has none.
CRC_SQL = """
tab AS (SELECT [list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) FOR i IN range(256)] AS t)
"""


def crc_sql(text: str) -> str:
    """SQL of the CRC-32 of ``text``; the query must have ``tab``."""
    octets = f"list_transform(range(length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, tab.t[xor(c, b) % 256 + 1])), 4294967295::BIGINT)"


#: A layer holds (cost, audit) by state; a turn gives each state its least candidate, then two rounds of inserts close it.
_PICK = {
    START: "[D0]", SYSTEM: "[D1, CASE WHEN r = 's' THEN K0 END]",
    USER: "[D2, CASE WHEN r = 'u' THEN K0 END, CASE WHEN r = 'u' THEN K1 END, CASE WHEN r = 'u' THEN K3 END, R0, R1, R3]",
    ASSISTANT: "[D3, CASE WHEN r = 'a' THEN K2 END, R2]",
}


def _edit(letter: str, state: int, cost: str, when: str = "") -> str:
    made = f"{{'c': p{state}.c + {cost}, 'a': p{state}.a || '{letter}'}}"
    return f"CASE WHEN {f'{when} AND ' if when else ''}p{state} IS NOT NULL THEN {made} END"


def _least(options: str) -> str:
    return f"list_min(list_filter({options}, lambda x: x IS NOT NULL))"


def _turn_sql(state: int) -> str:
    text = _PICK[state]
    for s in range(4):
        text = text.replace(f"D{s}", _edit("D", s, "3")).replace(f"K{s}", _edit("K", s, "(fault = 3)::INT", "fault IN (0, 3)"))
        text = text.replace(f"R{s}", _edit("R", s, "2 + (fault = 3)::INT", "fault IN (0, 3)"))
    return _least(text)


def _closing_sql(names: str, inner: str) -> str:
    """One round of inserts: user after nothing, system and assistant; assistant after user."""
    user = _least(f"[p2, {', '.join(_edit('I', s, '2') for s in (0, 1, 3))}]")
    return f"SELECT {names}, p0, p1, {user} AS p2, {_least('[p3, ' + _edit('I', 2, '2') + ']')} AS p3 FROM ({inner})"


_NAMES = "g, pos, n"
_STEP = f"SELECT w.g, d.pos, w.n, {', '.join(f'{_turn_sql(s)} AS p{s}' for s in range(4))} FROM (SELECT * FROM walk) w JOIN one d ON d.g = w.g AND d.pos = w.pos + 1"
_EMPTY = "SELECT g, 0::BIGINT AS pos, n, {'c': 0, 'a': ''} AS p0, NULL::STRUCT(c INT, a VARCHAR) AS p1, NULL::STRUCT(c INT, a VARCHAR) AS p2, NULL::STRUCT(c INT, a VARCHAR) AS p3 FROM total"

OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS g,
    {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, tab
),
hurt AS (
  SELECT g, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM hurt
),
one AS (
  SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY pos) AS r0,
    CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY pos) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
  FROM placed
),
total AS (SELECT g, count(*) AS n FROM one GROUP BY g),
walk AS (
  {_closing_sql(_NAMES, _closing_sql(_NAMES, _EMPTY))}
  UNION ALL
  {_closing_sql(_NAMES, _closing_sql(_NAMES, _STEP))}
),
found AS (SELECT g, {_least('[p0, p3]')} AS best FROM walk WHERE pos = n),
edits AS (
  SELECT g, i, substr(best.a, i::INT, 1) AS e, i - length(replace(left(best.a, i::INT), 'I', '')) AS ins, length(replace(best.a, 'D', '')) % 2 AS odd,
    length(replace(left(best.a, i::INT), 'D', '')) AS nth
  FROM found, unnest(range(1, length(best.a) + 1)) AS x(i)
),
lines AS (
  SELECT e.g, e.i, CASE WHEN e.e = 'K' THEN d.role WHEN (e.nth + e.odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e.e = 'I' THEN '' ELSE d.text END AS line
  FROM edits e LEFT JOIN one d ON d.g = e.g AND d.pos = e.i - e.ins AND e.e <> 'I' WHERE e.e <> 'D'
),
shown AS (SELECT g, string_agg(line, chr(10) ORDER BY i) AS body FROM lines GROUP BY g),
sums AS (
  SELECT g, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (r0 || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM one GROUP BY g
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS g FROM conversations) c LEFT JOIN sums USING (g) LEFT JOIN found USING (g) LEFT JOIN shown USING (g)
"""
