"""Structure repair of conversations: the cheapest edits that make the roles ``(s?(ua)+)?``, found once for each shared suffix of all conversations.

A row is a symbol of one byte: its role's initial (s, u, a, or any other), whether it must go (blank or a duplicate) and whether it is
truncated. A conversation is its string of symbols. Read from the end, all strings make an automaton whose nodes are suffixes: equal suffixes
of whatever conversations are one node. For every node and state of the role grammar there is one least cost to the end and one best first
edit, made from those of the node behind; an audit is read off by following the edits. Two best audits never begin with the same
letter, so ties are settled by the first letter alone.

Strings are dealt out by ranges of their reversed symbols and sorted, so that a task meets equal suffixes in a row and keeps only the nodes of
the current string; a node is computed once in a task, and tasks share at most the nodes of one string with the next. A string that most
conversations have is spread by conversation. Rows of a conversation are sorted by Spark and read as a stream, and so is the text for
the digest: a task holds one byte for each row of the conversation it is at, even if that has a third of all rows; its digest is one
sequence of bytes and can't be divided.

Null roles and texts are one space, so a null text is blank; null ids are one conversation. Rows are ordered by turn, nulls first, then by role, then by the
text's SHA-256; equal rows are adjacent and all but the first of them are duplicates. Very long texts pass through one at a time.
Conversations that lose every row stay, with zeros. Empty tables give no rows. Columns besides conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# Grammar states: nothing yet, after s, after u, after a. What an inserted or rerolled row becomes, and where that leads.
EXPECTED, NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: Where a kept row of each initial leads from each state; -1: not allowed.
KEPT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Symbols of the range key by which strings are dealt out.
DEALT = 32
_FAR = 1 << 60


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): rows after damage by the check value of ``conv_id:turn``; a dropped row stays as a mark with ``lost``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(kind == 4, "user").otherwise(text_of("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("lost"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, last, lost) of rows: the text as its digest and its last visible character, null in a blank one."""
    last = F.substring(F.rtrim("text", F.lit("\x20\t\n\x0b\x0c\r")), -1, 1)
    return rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("h"), F.when(last != "", last).alias("last"), "lost")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def with_first(rows: DataFrame) -> DataFrame:
    """``rows`` with ``again``: a row of its role and text stands at an earlier turn. Only texts that a conversation repeats are joined."""
    seen = rows.where(~F.col("lost") & F.col("last").isNotNull()).groupBy("conv_id", "role", "h").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    seen = seen.where("k > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("d"), F.col("first.turn").alias("first"))
    out = rows.join(seen, _same(F.col("conv_id"), F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("d")), "left")
    later = F.col("d").isNotNull() & F.col("turn").isNotNull() & (F.col("first").isNull() | (F.col("turn") > F.col("first")))
    return out.select(*rows.columns, later.alias("again"))


def _strings(kind: pa.DataType):
    """Batches of sorted rows to one row a conversation: its symbols, reversed, and its counts."""
    names = ["conv_id", "symbols", "gaps", "blank", "duplicate", "truncated", "illegal"]

    def run(batches):
        done: list[list] = [[] for _ in names]
        conv, symbols, state = None, None, None

        def end() -> None:
            first, last, distinct, faults, illegal = state["first"], state["last"], state["distinct"], state["faults"], state["illegal"]
            gaps = 0 if first is None else last - first + 1 - distinct
            for column, value in zip(done, (conv, bytes(symbols[::-1]), gaps, *faults, illegal), strict=True):
                column.append(value)

        def out() -> pa.RecordBatch:
            kinds = [kind, pa.binary(), *[pa.int64()] * 5]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, kinds, strict=True)], names)
            for c in done:
                c.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "h", "last", "lost", "again")]
            for c, turn, role, h, last, lost, again in zip(*columns, strict=True):
                if state is None or c != conv:
                    if state is not None:
                        end()
                    conv, symbols = c, bytearray()
                    state = {"first": None, "last": None, "distinct": 0, "faults": [0, 0, 0], "illegal": 0, "before": None, "role": None}
                if lost:
                    continue
                if turn is not None and turn != state["last"]:
                    state["first"] = turn if state["first"] is None else state["first"]
                    state["last"] = turn
                    state["distinct"] += 1
                same = state["before"] == (turn, role, h)
                fault = 0 if last is None else 1 if again or same else 2 if last not in ".!?" else 3
                if fault < 3:
                    state["faults"][fault] += 1
                initial = role[:1]
                if state["role"] is not None:
                    state["illegal"] += state["role"] + initial not in ("su", "ua", "au")
                state["role"], state["before"] = initial, (turn, role, h)
                known = initial if initial in KEPT else "o"
                symbols += (b"x" if fault < 2 else known.upper().encode() if fault == 2 else known.encode())
            if len(done[0]) > 2000:
                yield out()
        if state is not None:
            end()
        if done[0]:
            yield out()

    return run


class Suffixes:
    """The automaton's nodes of one string, from its end; a following string keeps those of the suffix that both share."""

    def __init__(self) -> None:
        self.symbols, self.made = b"", 0
        self.costs, self.edits = [], []
        self._node(None)

    def _node(self, symbol: str | None) -> None:
        if symbol is None:
            cost, edit = [0, _FAR, _FAR, 0], ["", "", "", ""]
        else:
            behind, cost, edit = self.costs[-1], [], []
            late = TRUNCATED if symbol.isupper() else 0
            kept = KEPT.get(symbol.lower())
            for state in range(4):
                options = [(DELETE + behind[state], "D")]
                if symbol != "x":
                    if kept and kept[state] >= 0:
                        options.append((late + behind[kept[state]], "K"))
                    options.append((REROLE + late + behind[NEXT[state]], "R"))
                best = min(options)
                cost.append(best[0])
                edit.append(best[1])
        # Insertions lead from a state to the next one in front of the same node; three in a row come back to where they were.
        for _ in range(3):
            for state in range(4):
                option = (INSERT + cost[NEXT[state]], "I")
                if option < (cost[state], edit[state]):
                    cost[state], edit[state] = option
        self.costs.append(cost)
        self.edits.append(edit)
        self.made += 1

    def read(self, symbols: bytes) -> None:
        """Moves to the string whose reversed symbols are given."""
        a, b = np.frombuffer(self.symbols, np.uint8), np.frombuffer(symbols, np.uint8)
        n = min(len(a), len(b))
        differs = np.flatnonzero(a[:n] != b[:n])
        shared = int(differs[0]) if len(differs) else n
        del self.costs[shared + 1 :], self.edits[shared + 1 :]
        for symbol in symbols[shared:].decode("ascii"):
            self._node(symbol)
        self.symbols = symbols

    def best(self) -> tuple[int, str]:
        """(cost, audit) of the current string."""
        state, at, audit = 0, len(self.symbols), []
        while True:
            edit = self.edits[at][state]
            if not edit:
                return self.costs[-1][0], "".join(audit)
            audit.append(edit)
            if edit in "IR":
                state = NEXT[state]
            elif edit == "K":
                state = KEPT[chr(self.symbols[at - 1]).lower()][state]
            at -= edit != "I"


def _audits(batches):
    """Batches of strings, sorted by reversed symbols, with cost and audit."""
    suffixes, last, found = Suffixes(), None, (0, "")
    for batch in batches:
        costs, audits = [], []
        for symbols in batch.column("symbols").to_pylist():
            if symbols != last:
                suffixes.read(symbols)
                last, found = symbols, suffixes.best()
            costs.append(found[0])
            audits.append(found[1])
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _COUNTS], pa.array(costs, pa.int64()), pa.array(audits, pa.string())], [*_COUNTS, "cost", "audit"])


_COUNTS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal"]


def repaired_rows(audit: str, rows):
    """(role, text) of the repaired conversation from its edits and the rows as they come."""
    state, rows = 0, iter(rows)
    for edit in audit:
        if edit == "I":
            role, text = EXPECTED[state], ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = EXPECTED[state]
        state = KEPT[role[:1]][state]
        yield role, text


def _digests(kind: pa.DataType, keep: bool):
    """Batches of (audit, then rows) a conversation, sorted, to the digest of its repaired text; ``keep``: the repaired rows themselves."""
    names = ["conv_id", "at", "role", "text"] if keep else [*_COUNTS, "cost", "audit", "repaired_sha256"]
    kinds = [kind, pa.int64(), pa.string(), pa.string()] if keep else [kind, *[pa.int64()] * 6, pa.string(), pa.string()]

    def stream(batches):
        for batch in batches:
            yield from batch.to_pylist()

    def conversations(batches):
        """Per conversation its head and its rows, which the caller reads as a stream before the next head."""
        rows = stream(batches)
        row = next(rows, None)
        while row is not None:
            head, ahead = row, [next(rows, None)]

            def own(ahead=ahead):
                while ahead[0] is not None and not ahead[0]["head"]:
                    yield ahead[0]["role"], ahead[0]["text"]
                    ahead[0] = next(rows, None)

            mine = own()
            yield head, mine
            for _ in mine:  # rows behind the last edit: none is left if the audit fits
                pass
            row = ahead[0]

    def run(batches):
        done: list[tuple] = []
        size = 0
        for head, rows in conversations(batches):
            digest, first = hashlib.sha256(), True
            for at, (role, text) in enumerate(repaired_rows(head["audit"], rows)):
                if keep:
                    done.append((head["conv_id"], at, role, text))
                    size += len(text)
                else:
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
                if len(done) > 2000 or size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
                    done, size = [], 0
            if not keep:
                done.append((*[head[c] for c in _COUNTS], head["cost"], head["audit"], digest.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    return run


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of ``rows(conv_id, turn, role, text, lost)``."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("h")]
    sorted_ = with_first(marked(rows)).repartition("conv_id").sortWithinPartitions(*order)
    counts = "gaps long, blank long, duplicate long, truncated long, illegal long"
    strings = stage(sorted_.mapInArrow(_strings(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, symbols binary, {counts}"), "turns-strings")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = strings.withColumn("near", F.substring("symbols", 1, DEALT)).withColumn("spread", F.xxhash64("conv_id"))
    dealt = dealt.repartitionByRange(parts, "near", "spread").sortWithinPartitions("symbols")
    return stage(dealt.mapInArrow(_audits, f"conv_id {kind.simpleString()}, {counts}, cost long, audit string"), "turns-audits")


def repair(rows: DataFrame, keep: bool = False) -> DataFrame:
    """``audits`` of ``rows(conv_id, turn, role, text, lost)`` with repaired_sha256; with ``keep`` the repaired rows (conv_id, at, role, text) instead."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    found = audits(rows).withColumns({"head": F.lit(True), "turn": F.lit(None).cast(rows.schema["turn"].dataType), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "h": F.lit(None).cast("string")})
    body = rows.where(~F.col("lost")).select("conv_id", "turn", "role", "text", F.sha2("text", 256).alias("h"), F.lit(False).alias("head"))
    both = found.unionByName(body, allowMissingColumns=True)
    order = [F.asc_nulls_first("conv_id"), F.desc("head"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("h")]
    both = both.repartition("conv_id").sortWithinPartitions(*order)
    name = kind.simpleString()
    schema = f"conv_id {name}, at long, role string, text string" if keep else f"conv_id {name}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return both.mapInArrow(_digests(to_arrow_type(kind), keep), schema)


def op12_turns(spark, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


# The comparison SQL: check values byte by byte, then the costs and audits from each conversation's end, one key of both for each state.
def _plus(key: str, cost: str, edit: str) -> str:
    return f"printf('%012d', CAST(substr({key}, 1, 12) AS BIGINT) + {cost}) || '{edit}' || substr({key}, 13)"


def _step(state: int) -> str:
    kept = " ".join(f"WHEN '{i}' THEN " + (_plus(f"p.v{to[state]}", "late", "K") if to[state] >= 0 else "'999999999999'") for i, to in KEPT.items())
    reroled = _plus(f"p.v{NEXT[state]}", f"{REROLE} + late", "R")
    return f"least({_plus(f'p.v{state}', str(DELETE), 'D')}, CASE WHEN gone THEN '999999999999' ELSE least(CASE initial {kept} ELSE '999999999999' END, {reroled}) END) AS w{state}"


def _inserted(w: str, state: int) -> str:
    one, two = NEXT[state], NEXT[NEXT[state]]
    again = _plus("(" + _plus(f"{w}{two}", str(INSERT), "I") + ")", str(INSERT), "I")
    return f"least({w}{state}, {_plus(f'{w}{one}', str(INSERT), 'I')}, {again}) AS v{state}"


OP12_SQL = (
    r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
d AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, crc),
r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last, role[1] AS initial FROM r),
f AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT contains('.!?', last) THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
n AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM f),
c AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
p(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, rows + 1, '000000000000', '000000000006II', '000000000003I', '000000000000' FROM c
  UNION ALL SELECT conv_id, i, """
    + ", ".join(_inserted("w", s) for s in range(4))
    + """ FROM (SELECT p.conv_id, p.i - 1 AS i, """
    + ", ".join(_step(s) for s in range(4))
    + r""" FROM p JOIN n ON n.conv_id = p.conv_id AND n.i = p.i - 1)),
b AS (SELECT conv_id, CAST(substr(v0, 1, 12) AS BIGINT) AS cost, substr(v0, 13) AS audit FROM p WHERE i = 1),
e AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS m FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS j, unnest(string_split(audit, '')) AS edit FROM b WHERE audit <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
x AS (SELECT e.conv_id, edit, m, n.role, n.text, max(CASE WHEN m = 1 AND edit = 'K' AND n.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS s FROM e LEFT JOIN n ON n.conv_id = e.conv_id AND n.i = e.i WHERE edit <> 'D'),
h AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY m) AS body FROM x GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN c USING (conv_id) LEFT JOIN b USING (conv_id) LEFT JOIN h USING (conv_id)
"""
)
