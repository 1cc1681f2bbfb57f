"""Cheapest repair of the structure of conversations.

A repaired conversation's roles read (s?(ua)+)?: maybe a system turn, then user and assistant in turn. Turns are kept, get
another role, are deleted, or empty ones are put between. Conversations are dealt over tasks by a hash, and a DuckDB recursive
query over a batch of them takes one more turn of all its conversations a step: its keyed result holds, for each state of the
grammar, the least cost and, of the edits that cost so much, the least audit. Equal costs mean equally many insertions, so
that no audit of them goes on from another, and the least one stays so whatever follows.

A conversation of more than BLOCK turns is cut into blocks of that many. A block's query starts from every state; what the
blocks have found is combined from the first to the last, and only then is each block told its part of the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import head, ranked, settle, slices, spread_join

#: Turns from which on a conversation is more than one block, and turns that one query takes.
BLOCK, BATCH = 512, 32_768
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What a turn may be (initial of its role, o for others; d must be deleted) and states: nothing yet, after s, u and a.
KINDS, STATES, FINAL = "suaod", range(4), (0, 3)
_ADDS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ROLES = {"u": "user", "a": "assistant"}
_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPAIRED = "conv_id long, part int, parts int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"
_BLOCKS = "conv_id long, block int, n long, low long, high long, distinct long, first string, last string, blank long, duplicate long, truncated long, illegal long, moves array<struct<f: int, t: int, cost: long, audit: string>>"


def _inserted(state: int) -> list[tuple[int, int]]:
    """(state, insertions): what up to two insertions lead to; a third would only undo them."""
    out = [(state, 0)]
    for _ in range(2):
        last, n = out[-1]
        out += [(to, n + 1) for (at, role), to in _ADDS.items() if at == last and role in _ROLES]
    return out


def _moves() -> list[tuple[str, bool, int, int, int, str]]:
    """(kind, truncated, state, next state, cost, audit) of every way over a turn, insertions before it among them."""
    out = []
    for state in STATES:
        for at, n in _inserted(state):
            for kind in KINDS:
                for truncated in (False, True):
                    before, more = n * INSERT, TRUNCATED * truncated
                    out.append((kind, truncated, state, at, before + DELETE, "I" * n + "D"))
                    if kind == "d":
                        continue
                    if (at, kind) in _ADDS:
                        out.append((kind, truncated, state, _ADDS[at, kind], before + KEEP + more, "I" * n + "K"))
                    out += [(kind, truncated, state, _ADDS[at, r], before + REROLE + more, "I" * n + "R") for r in _ROLES if (at, r) in _ADDS]
    return out


def closing(state: int) -> list[int]:
    """Numbers of insertions that end in a whole conversation; the last one costs least."""
    return [n for to, n in _inserted(state) if to in FINAL]


_QUERY = f"""
WITH RECURSIVE best(unit, f, s, i, b) USING KEY (unit, f, s) AS (
  SELECT unit, f, f, 0::BIGINT, {{'c': 0::BIGINT, 'a': ''}} FROM units CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS f) WHERE NOT whole OR f = 0
  UNION ALL
  SELECT best.unit, best.f, m.t, best.i + 1, min({{'c': best.b.c + m.cost, 'a': best.b.a || m.audit}})
  FROM best JOIN marked r ON r.unit = best.unit AND r.i = best.i + 1 JOIN moves m ON m.s = best.s AND m.kind = r.kind AND m.truncated = r.truncated
  GROUP BY best.unit, best.f, m.t, best.i)
SELECT unit, f, s, b.c AS cost, b.a AS audit FROM best ORDER BY unit, f, s
"""
_MARK = """
CREATE OR REPLACE TEMP TABLE marked AS
WITH a AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, coalesce(dup, row_number() OVER (PARTITION BY unit, role, text ORDER BY i) > 1) AS again,
    CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial FROM turns),
b AS (SELECT *, again AND NOT blank AS duplicate, NOT again AND NOT blank AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS truncated, lag(initial) OVER (PARTITION BY unit ORDER BY i) AS before FROM a)
SELECT unit, i, turn, initial, blank, duplicate, truncated, CASE WHEN blank OR duplicate THEN 'd' ELSE initial END AS kind,
  before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') AS illegal FROM b
"""
_COUNT = """
SELECT unit, count(*) AS n, min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS distinct_turns, arg_min(initial, i) AS first, arg_max(initial, i) AS last,
  count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
FROM marked GROUP BY unit ORDER BY unit
"""


def _connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
    con.execute("CREATE TABLE moves(kind VARCHAR, truncated BOOLEAN, s INTEGER, t INTEGER, cost BIGINT, audit VARCHAR)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", _moves())
    return con


def apply_edits(turns: list[tuple[str, str]], audit: str, state: int = 0) -> list[str]:
    """role:text of what the edits make of turns (role, text), from a state of the grammar on."""
    out, rest = [], iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit == "K":
            state = _ADDS[state, role[:1]]
        else:
            r = next(r for r in _ROLES if (state, r) in _ADDS)
            role, state = _ROLES[r], _ADDS[state, r]
        out.append(f"{role}:{text}")
    return out


def _units(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[tuple, list[tuple]]]]:
    """Lots of whole units ((conv_id, block), turns), of about most turns; rows come sorted by unit."""
    lot, size = [], 0
    for batch in slices(batches):
        for conv, block, *turn in zip(*(c.to_pylist() for c in batch.columns)):
            if not lot or lot[-1][0] != (conv, block):
                if size >= most:
                    yield lot
                    lot, size = [], 0
                lot.append(((conv, block), []))
            lot[-1][1].append(turn)
            size += 1
    if lot:
        yield lot


def _solved(con: duckdb.DuckDBPyConnection, lot: list, whole: bool) -> Iterator[tuple[tuple, list, tuple, list[tuple]]]:
    """(unit, its turns, its counts, (f, s, cost, audit) rows) of each unit of a lot."""
    rows = [(u, i, turn, role, text, dup) for u, (_, own) in enumerate(lot) for i, (turn, role, text, dup) in enumerate(own, 1)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
    con.register("turns", pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["unit", "i", "turn", "role", "text", "dup"]))
    con.execute(_MARK)
    con.register("units", pa.table({"unit": pa.array(range(len(lot)), pa.int64()), "whole": pa.array([whole] * len(lot), pa.bool_())}))
    best: list[list[tuple]] = [[] for _ in lot]
    for unit, *row in con.execute(_QUERY).fetchall():
        best[unit].append(tuple(row))
    counts = [row[1:] for row in con.execute(_COUNT).fetchall()]
    con.unregister("turns")
    for (unit, own), c, b in zip(lot, counts, best):
        yield unit, own, c, b


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)


def _whole(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for lot in _units(batches, BATCH):
            out = []
            for (conv, _), own, (_, low, high, distinct, _, _, *counts), best in _solved(con, lot, True):
                cost, audit, = min((c + n * INSERT, a + "I" * n) for _, s, c, a in best for n in closing(s))
                lines = apply_edits([(role, text) for _, role, text, _ in own], audit)
                out.append((conv, 0, 1, _gaps(low, high, distinct), *counts, cost, audit, "\n".join(lines)))
            yield _batch(out, schema)

    return run


def _blocks(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for lot in _units(batches, BATCH // 4):
            yield _batch([(*unit, *counts, [{"f": f, "t": s, "cost": c, "audit": a} for f, s, c, a in best]) for unit, _, counts, best in _solved(con, lot, False)], schema)

    return run


class _Fold:
    """The blocks of one conversation, one after another."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.best, self.back = conv, {0: (0, "")}, []
        self.low = self.high = None
        self.distinct, self.last, self.counts = 0, None, [0, 0, 0, 0]

    def add(self, low, high, distinct, first, last, counts, moves) -> None:
        self.distinct += distinct - (low is not None and low == self.high)
        self.low, self.high = low if self.low is None else self.low, self.high if high is None else high
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        self.counts[3] += self.last is not None and self.last + first not in ("su", "ua", "au")
        self.last = last
        best, back = {}, {}
        for m in moves:
            if m["f"] in self.best:
                cost, audit = self.best[m["f"]]
                new = (cost + m["cost"], audit + m["audit"])
                if m["t"] not in best or new < best[m["t"]]:
                    best[m["t"]], back[m["t"]] = new, m["f"]
        self.best = best
        self.back.append(bytes(back.get(s, 255) for s in STATES))

    def rows(self) -> Iterator[tuple]:
        cost, _, state, n = min((c + n * INSERT, a + "I" * n, s, n) for s, (c, a) in self.best.items() for n in closing(s))
        path = [state]
        for back in reversed(self.back):
            path.append(back[path[-1]])
        path.reverse()
        parts = len(self.back)
        for block in range(parts):
            yield (self.conv, block, parts, _gaps(self.low, self.high, self.distinct), *self.counts, cost, path[block], path[block + 1], "I" * n * (block == parts - 1))


def _fold(schema: pa.Schema):
    """Where each block's edits begin and end, for conversations that come block after block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in slices(batches, 64):
            out = []
            for conv, block, _, low, high, distinct, first, last, *counts, moves in zip(*(c.to_pylist() for c in batch.columns)):
                if block == 0:
                    if own:
                        out += own.rows()
                    own = _Fold(conv)
                own.add(low, high, distinct, first, last, counts, moves)
            for at in range(0, len(out), 4096):
                yield _batch(out[at : at + 4096], schema)
        if own:
            out = list(own.rows())
            for at in range(0, len(out), 4096):
                yield _batch(out[at : at + 4096], schema)

    return run


def _applied(schema: pa.Schema):
    """Blocks' turns with their edits; turns come sorted by block, and each has what its block is told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _units(batches, 1):
            for (conv, block), own in lot:
                *_, parts, gaps, blank, duplicate, truncated, illegal, cost, state, audit = own[0]
                lines = apply_edits([(r[0], r[1]) for r in own], audit, state)
                yield _batch([(conv, block, parts, gaps, blank, duplicate, truncated, illegal, cost, audit, "\n".join(lines))], schema)

    return run


def _long_ones(rows: DataFrame) -> DataFrame:
    """The parts of conversations that are several blocks; rows have _none, _conv, turn, role, text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = lambda text: to_arrow_schema(StructType.fromDDL(text))
    conv = ["_none", "_conv"]
    at = settle(ranked(rows, [*conv, "turn", "role", "text"], "_rank", [*conv, "turn", "role", head("text")]))
    starts = at.groupBy(*conv).agg(F.min("_rank").alias("_start"))
    firsts = at.groupBy(*conv, "role", F.sha2(F.col("text").cast("binary"), 256).alias("_text")).agg(F.min("_rank").alias("_rank")).select("_rank", F.lit(False).alias("_again"))
    placed = spread_join(at, starts, conv).withColumn("_i", F.col("_rank") - F.col("_start")).join(firsts, "_rank", "left")
    ids = (F.when(~F.col("_none"), F.col("_conv")).alias("conv_id"), F.floor(F.col("_i") / BLOCK).cast("int").alias("block"))
    turns = settle(placed.select(*ids, "_i", "turn", "role", "text", F.coalesce("_again", F.lit(True)).alias("dup")))
    by_block = turns.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "_i").select("conv_id", "block", "turn", "role", "text", "dup")
    blocks = settle(by_block.mapInArrow(_blocks(schema(_BLOCKS)), _BLOCKS))
    told = "conv_id long, block int, parts int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, f int, t int, closing string"
    path = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_fold(schema(told)), told)
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["block"] == b["block"])
    moves = blocks.select("conv_id", "block", F.explode("moves").alias("m"))
    chosen = path.join(moves, same(path, moves) & (path["f"] == F.col("m.f")) & (path["t"] == F.col("m.t"))).select(path["*"], F.concat("m.audit", "closing").alias("audit"))
    edited = turns.join(chosen, same(turns, chosen)).select(turns["conv_id"], turns["block"], "_i", "role", "text", "parts", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "f", "audit")
    edited = edited.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "_i").drop("_i")
    return edited.mapInArrow(_applied(schema(_REPAIRED)), _REPAIRED)


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, part, parts, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired, is_cut): what is wrong with
    each conversation, the cheapest edits and what they give.

    turns: rows (conv_id, turn, role, text), other columns are ignored; a conversation's turns go by turn, nulls first, ties by
    role and text. Null role and text count as one space. Rows without conv_id are one conversation. Roles other than those
    that begin with s, u or a fit nowhere. A turn without anything but white space is blank; one whose role and text were there
    before is a duplicate; one that doesn't end in . ! or ? is truncated; the first of these that holds counts. repaired has a
    line role:text for each turn that is left.

    A conversation of at most BLOCK turns is one row, part 0 of 1 part. Longer ones are several rows (is_cut), of BLOCK turns each,
    that agree in parts and figures; their audits, and their repaired lines that aren't empty, go on from each other. An empty table
    gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    rows = rows.select(F.col("conv_id").isNull().alias("_none"), F.coalesce("conv_id", F.lit(0)).alias("_conv"), "turn", "role", "text")
    conv = ["_none", "_conv"]
    long = settle(rows.groupBy(*conv).agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK).select(*conv))
    some = not long.isEmpty()
    short = rows
    if some:
        rows = settle(rows)
        told = spread_join(rows, long.withColumn("_long", F.lit(True)), conv, "left")
        short, rest = told.filter(F.col("_long").isNull()).drop("_long"), told.filter("_long").drop("_long")
    whole = short.repartition(*conv).sortWithinPartitions(*conv, "turn", "role", "text")
    whole = whole.select(F.when(~F.col("_none"), F.col("_conv")).alias("conv_id"), F.lit(0).alias("block"), "turn", "role", "text", F.lit(None).cast("boolean").alias("dup"))
    out = whole.mapInArrow(_whole(to_arrow_schema(StructType.fromDDL(_REPAIRED))), _REPAIRED).withColumn("is_cut", F.lit(False))
    return out.unionByName(settle(_long_ones(rest)).withColumn("is_cut", F.lit(True))) if some else out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, audit, sha256 of the repaired lines) of conversations that come part after part."""
    schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    now = None
    for batch in slices(batches, 64):
        out = []
        for conv, part, audit, repaired in zip(*(c.to_pylist() for c in batch.columns)):
            if part == 0:
                if now:
                    out.append((now[0], "".join(now[1]), now[2].hexdigest()))
                now = [conv, [], hashlib.sha256(), False]
            now[1].append(audit)
            if repaired:
                now[2].update(("\n" * now[3] + repaired).encode())
                now[3] = True
        yield _batch(out, schema)
    if now:
        yield _batch([(now[0], "".join(now[1]), now[2].hexdigest())], schema)


def joined(repaired: DataFrame) -> DataFrame:
    """One row a conversation of repair's rows: figures, the whole audit, and the digest of the repaired lines. The cut ones
    are told by a column that is constant in each part of repair's union, so that a filter by it repairs nothing twice."""
    figures = ["conv_id", *_FIGURES]
    short = repaired.filter(~F.col("is_cut")).select(*figures, "audit", F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))
    parts = repaired.filter("is_cut")
    digests = parts.select("conv_id", "part", "audit", "repaired").repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "part", "audit", "repaired")
    digests = digests.mapInArrow(_digests, "conv_id long, audit string, repaired_sha256 string")
    long = parts.filter(F.col("part") == 0).select(*figures)
    long = long.join(digests, long["conv_id"].eqNullSafe(digests["conv_id"])).select(long["*"], "audit", "repaired_sha256")
    return short.unionByName(long)


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with faults: by a hash of conversation and turn some go, lose their text or its full stops, come twice, or
    get the role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_kind")).filter(F.col("_kind") != 0)
    new = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), new.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = joined(repair(damaged(turns))).withColumnRenamed("conv_id", "_id")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(found, every["conv_id"].eqNullSafe(found["_id"]), "left").drop("_id")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _FIGURES), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
