"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

A conversation is legal if the initials of its roles are ``(s?(ua)+)?``; the
automaton of that has four states. Each turn is a 4x4 matrix: the entry (i, j)
is the cheapest way, as (cost, audit), from state i to j by any inserts and
then one edit of the turn. Matrices multiply over (min, +) with audits joined,
the ASCII-least of equally dear ones kept, which is associative:

* an audit of n turns holds n letters other than I and ends with one, so that
  none is the proper prefix of another, and the order of two does not change
  by what follows;
* so a product needs no strings: the rank of an entry's audit among the
  sixteen, and the state in the middle, which the way back reads.

Turns lie in one global order over all tasks. A task reduces its turns in
blocks by a balanced tree, numpy multiplying the pairs of all trees at once.
Blocks of a conversation that goes over several of them are reduced by a
wider tree of Spark groups, up for the products and down for the states
between blocks. No task holds more of a conversation than a block of at most
``BATCH_ROWS`` turns and about ``BLOCK_BYTES`` of text, or FAN products; only
the audit of a conversation, one string of the result, and its hash, which
goes through blocks one after another, are made as a whole.

Null in role or text is one space, so such a text is blank; null conv_id is a
conversation, and null turns come first. Rows of one turn are in order of role
and the MD5 of the text; repeated rows are duplicates. An empty table gives an
empty one. Texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, only

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Blocks or products of a group that one task multiplies, and bytes of text after which a block ends.
FAN_BITS, BLOCK_BYTES = 12, 1 << 20

_BLANK = " \t\n\x0b\x0c\r"
_INITIALS = "sua"
_OK, _IS_BLANK, _IS_DUPLICATE, _IS_TRUNCATED = 0, 1, 2, 3
_FAR = 1 << 48
#: Where an initial leads from each state (start, after s, after u, after a), and what an insert does.
_STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_AFTER_INSERT = {0: 2, 1: 2, 2: 3, 3: 2}


# --- the matrices


def _closure() -> list[list[tuple[int, str]]]:
    """(cost, audit) of the cheapest inserts from each state to each."""
    out = [[(_FAR, "")] * 4 for _ in range(4)]
    for i in range(4):
        state, n = i, 0
        while out[i][state][0] == _FAR:
            out[i][state] = (INSERT * n, "I" * n)
            state, n = _AFTER_INSERT[state], n + 1
    return out


def _kinds() -> tuple[np.ndarray, np.ndarray, list[list[list[str]]]]:
    """Costs, ranks and audits of the matrix of each kind of turn: 4 * fault + initial (s, u, a or another)."""
    closure, costs, ranks, audits = _closure(), [], [], []
    for fault in range(4):
        for initial in ("s", "u", "a", ""):
            extra = TRUNCATED if fault == _IS_TRUNCATED else 0
            ways: list[tuple[int, int, int, str]] = [(i, i, DELETE, "D") for i in range(4)]
            if fault in (_OK, _IS_TRUNCATED):
                ways += [(i, j, KEEP + extra, "K") for i, j in _STEP.get(initial, {}).items()]
                ways += [(i, j, REROLE + extra, "R") for x in "ua" for i, j in _STEP[x].items()]
            m = [[min(((closure[i][k][0] + c, closure[i][k][1] + x) for k, to, c, x in ways if to == j), default=(_FAR, "~")) for j in range(4)] for i in range(4)]
            m = [[x if x[0] < _FAR else (_FAR, "~") for x in row] for row in m]
            order = sorted({x[1] for row in m for x in row})
            costs.append([[x[0] for x in row] for row in m])
            ranks.append([[order.index(x[1]) for x in row] for row in m])
            audits.append([[x[1] for x in row] for row in m])
    return np.array(costs, np.int64), np.array(ranks, np.int64), audits


def product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of matrices (n, 4, 4) given as costs and ranks: costs, ranks, and the state in the middle of each entry."""
    cost = np.minimum(a[0][:, :, :, None] + b[0][:, None, :, :], _FAR)
    key = (cost << 8) + (a[1][:, :, :, None] << 4) + b[1][:, None, :, :]
    via = key.argmin(axis=2)
    best = np.take_along_axis(key, via[:, :, None, :], 2)[:, :, 0, :]
    pair = (best & 255).reshape(-1, 16)
    rank = (pair[:, None, :] < pair[:, :, None]).sum(axis=2).reshape(-1, 4, 4)
    return best >> 8, rank, via


def reduced(cost: np.ndarray, rank: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """The products of runs of matrices, each beginning at one of ``first``, by balanced trees, and the trees for descend()."""
    n = np.diff(np.r_[first, len(cost)])
    levels = []
    while len(cost) > len(n):
        at = np.arange(len(cost)) - np.repeat(np.cumsum(n) - n, n)
        left = np.flatnonzero(at % 2 == 0)
        paired = at[left] + 1 < np.repeat(n, (n + 1) // 2)
        some = left[paired]
        new_cost, new_rank = cost[left], rank[left]
        new_cost[paired], new_rank[paired], via = product((cost[some], rank[some]), (cost[some + 1], rank[some + 1]))
        levels.append((len(cost), left, paired, via))
        cost, rank, n = new_cost, new_rank, (n + 1) // 2
    return cost, rank, levels


def descend(levels: list, entry: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states before and after each matrix on the best ways of the products."""
    for size, left, paired, via in reversed(levels):
        e, x = np.zeros(size, np.int64), np.zeros(size, np.int64)
        e[left], x[left] = entry, leave
        some = left[paired]
        middle = via[np.arange(len(some)), entry[paired], leave[paired]]
        e[some + 1], x[some + 1], x[some] = middle, leave[paired], middle
        entry, leave = e, x
    return entry, leave


def ending(cost: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best state after all turns, from the start, with the inserts that end a conversation there; and the whole cost."""
    tail = np.array([0, 2, 1, 0]) * INSERT
    total = np.minimum(cost[:, 0, :] + tail, _FAR)
    leave = ((total << 4) + rank[:, 0, :]).argmin(axis=1)
    return leave, total[np.arange(len(total)), leave]


# --- rows before and after damage


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies: rows after the faults that crc32 of ``conv_id:turn`` deals."""
    d = only(conversations, conv_id="long", turn="long", role="string", text="string").fillna(" ", ["role", "text"])
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    return d.filter(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """Turns with the names that joins use: ``conv`` and ``place`` are '' for null, ``key`` stands for the text."""
    d = only(rows, conv_id="long", turn="long", role="string", text="string", copies="long").fillna(" ", ["role", "text"]).fillna(1, ["copies"])
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return d.select(name("conv_id").alias("conv"), name("turn").alias("place"), "turn", "role", F.md5(F.encode("text", "UTF-8")).alias("key"), "text", "copies")


def _facts(rows: DataFrame) -> DataFrame:
    """A row for each turn, without its text: its place, the kind of its matrix and its bytes.

    Equal rows are counted before they are shuffled and dealt out again as
    copies, so that a row repeated without end is no hot key.
    """
    end = F.right(F.rtrim("text", F.lit(_BLANK)), F.lit(1))
    d = rows.select("conv", "turn", "role", "key", "copies", end.alias("end"), F.octet_length("text").alias("size"))
    d = d.groupBy("conv", "turn", "role", "key").agg(F.sum("copies").alias("n"), F.first("end").alias("end"), F.first("size").alias("size"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    again = d.groupBy("conv", "role", "key").agg(F.min(place).alias("seen"), F.count("*").alias("times")).filter("times > 1").drop("times")
    d = d.join(again, ["conv", "role", "key"], "left").withColumn("late", F.coalesce(place > F.col("seen"), F.lit(False)))
    step = 1 << 12
    d = d.withColumn("some", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step).cast("long"))))
    d = d.withColumn("copy", F.explode(F.sequence("some", F.least(F.col("some") + (step - 1), F.col("n") - 1))))
    fault = F.when(F.col("end") == "", _IS_BLANK).when(F.col("late") | (F.col("copy") > 0), _IS_DUPLICATE).when(~F.col("end").isin(".", "!", "?"), _IS_TRUNCATED).otherwise(_OK)
    initial = F.instr(F.lit(_INITIALS), F.substring("role", 1, 1))
    kind = 4 * fault + F.when((initial > 0) & (F.col("role") != ""), initial - 1).otherwise(3)
    return d.select("conv", "turn", "role", "key", "copy", kind.cast("int").alias("kind"), F.col("size").cast("long").alias("size"))


_TURN = "struct<turn:bigint,role:string,key:string>"
_BLOCKS = f"conv string, at long, whole boolean, n long, blank long, duplicate long, truncated long, illegal long, turns long, first int, last int, first_turn long, last_turn long, kinds binary, cost binary, rank binary, exit int, total long, rows array<{_TURN}>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the turns of a task, which come in order: counts, and the product of their matrices."""
    from pyspark import TaskContext

    costs, ranks, _ = _kinds()
    at = TaskContext.get().partitionId() << 32
    for b in batches:
        if not b.num_rows:
            continue
        n = b.num_rows
        conv = b.column("conv").dictionary_encode()
        number = conv.indices.to_numpy(zero_copy_only=False)
        new_conv = np.diff(number, prepend=-1) != 0
        bucket = np.cumsum(b.column("size").to_numpy(zero_copy_only=False)) // BLOCK_BYTES
        first = np.flatnonzero(new_conv | (np.diff(bucket, prepend=0) != 0))
        kind = b.column("kind").to_numpy(zero_copy_only=False).astype(np.int64)
        fault, initial = kind >> 2, kind & 3
        end = np.r_[first[1:], n]
        cost, rank, _ = reduced(costs[kind], ranks[kind], first)
        leave, total = ending(cost, rank)
        inside = np.ones(n, bool)
        inside[first] = False
        before = np.r_[-1, initial[:-1]]
        legal = ((before == 0) & (initial == 1)) | ((before == 1) & (initial == 2)) | ((before == 2) & (initial == 1))
        null = np.array(b.column("turn").is_null())
        turn = b.column("turn").fill_null(0).to_numpy(zero_copy_only=False)
        fresh = ~null & ~(inside & np.r_[False, ~null[:-1]] & (turn == np.r_[0, turn[:-1]]))
        add = lambda x: np.add.reduceat(x.astype(np.int64), first)
        some = add(~null) > 0
        # of the turns of a block nulls come first
        least = turn[np.minimum(first + add(null), n - 1)]
        # a conversation that touches neither end of the batch is here as a whole, if one block holds it
        starts = new_conv[first] & (first > 0)
        ends = np.r_[new_conv[first[1:]], False]
        rows = pa.StructArray.from_arrays([b.column("turn"), b.column("role"), b.column("key")], ["turn", "role", "key"])
        data = kind.astype("u1").tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                b.column("conv").take(pa.array(first)),
                pa.array(at + np.arange(len(first))),
                pa.array(starts & ends),
                pa.array(end - first),
                *(pa.array(add(fault == f)) for f in (_IS_BLANK, _IS_DUPLICATE, _IS_TRUNCATED)),
                pa.array(add(inside & ~legal)),
                pa.array(add(fresh)),
                pa.array(initial[first].astype(np.int32)),
                pa.array(initial[end - 1].astype(np.int32)),
                pa.array(least, mask=~some),
                pa.array(turn[end - 1], mask=~some),
                pa.array([data[s:e] for s, e in zip(first.tolist(), end.tolist(), strict=True)], pa.binary()),
                pa.array([x.astype("<i8").tobytes() for x in cost], pa.binary()),
                pa.array([x.astype("u1").tobytes() for x in rank], pa.binary()),
                pa.array(leave.astype(np.int32)),
                pa.array(total),
                pa.ListArray.from_arrays(pa.array(np.r_[first, n].astype(np.int32)), rows),
            ],
            names=[x.split(" ")[0] for x in _BLOCKS.split(", ")],
        )
        at += len(first)


# --- conversations of many blocks


def _matrices(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    cost = np.frombuffer(b"".join(t.column("cost").to_pylist()), "<i8").reshape(-1, 4, 4)
    rank = np.frombuffer(b"".join(t.column("rank").to_pylist()), "u1").reshape(-1, 4, 4)
    return cost, rank.astype(np.int64)


_ZERO = np.zeros(1, np.int64)


def _multiplied(t: pa.Table) -> pa.Table:
    """The product of the nodes of a group, in order."""
    t = t.sort_by("at")
    cost, rank, _ = reduced(*_matrices(t), _ZERO)
    return pa.table({"conv": t.column("conv")[:1], "at": t.column("up")[:1], "cost": [cost[0].astype("<i8").tobytes()], "rank": [rank[0].astype("u1").tobytes()]})


def _states(t: pa.Table) -> pa.Table:
    """The states before and after each node of a group; those of the group are given, or are a whole conversation's."""
    t = t.sort_by("at")
    cost, rank, levels = reduced(*_matrices(t), _ZERO)
    leave, total = ending(cost, rank)
    if "entry" in t.column_names:
        entry, leave, total = (np.array(t.column(c)[:1].to_pylist(), np.int64) for c in ("entry", "exit", "total"))
    else:
        entry = _ZERO
    e, x = descend(levels, entry, leave)
    return pa.table({"conv": t.column("conv"), "at": t.column("at"), "entry": pa.array(e, pa.int32()), "exit": pa.array(x, pa.int32()), "total": pa.array(np.repeat(total, len(e)))})


_STATES = "conv string, at long, entry int, exit int, total long"


def _paths(spark: SparkSession, nodes: DataFrame, bits: int) -> DataFrame:
    """States before and after each node (conv, at, cost, rank) on its conversation's best way, by a tree of groups of at most 2^bits."""
    most = nodes.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    if most <= 1 << bits:
        return nodes.groupBy("conv").applyInArrow(_states, _STATES)
    nodes = nodes.withColumn("up", F.shiftright("at", bits))
    above = kept(spark, nodes.groupBy("conv", "up").applyInArrow(_multiplied, "conv string, at long, cost binary, rank binary"))
    states = _paths(spark, above, bits).withColumnRenamed("at", "up")
    return nodes.join(states, ["conv", "up"]).groupBy("conv", "up").applyInArrow(_states, _STATES)


_EDITS = "edits array<string>, states binary"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the edits of their turns and the states before these."""
    costs, ranks, audits = _kinds()
    for b in batches:
        if not b.num_rows:
            continue
        parts = b.column("kinds").to_pylist()
        kind = np.frombuffer(b"".join(parts), "u1").astype(np.int64)
        n = np.array([len(x) for x in parts])
        first = np.cumsum(n) - n
        _, _, levels = reduced(costs[kind], ranks[kind], first)
        e, x = descend(levels, *(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("entry", "exit")))
        edits = [audits[k][i][j] for k, i, j in zip(kind.tolist(), e.tolist(), x.tolist(), strict=True)]
        data = e.astype("u1").tobytes()
        drop = b.schema.get_field_index("kinds")
        rest = [c for i, c in enumerate(b.columns) if i != drop]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.ListArray.from_arrays(pa.array(np.r_[first, len(kind)].astype(np.int32)), pa.array(edits, pa.string())), pa.array([data[s : s + m] for s, m in zip(first.tolist(), n.tolist(), strict=True)], pa.binary())],
            names=[c for c in b.schema.names if c != "kinds"] + ["edits", "states"],
        )


class Repair:
    """The repair of a table of turns (conv_id, turn, role, text, and perhaps copies)."""

    def __init__(self, spark: SparkSession, turns: DataFrame, fan_bits: int = FAN_BITS):
        self.rows = _keyed(turns)
        facts = kept(spark, _facts(self.rows))
        order = ["conv", F.asc_nulls_first("turn"), "role", "key", "copy"]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        blocks = kept(spark, facts.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks, _BLOCKS))
        several = blocks.filter("not whole")
        states = kept(spark, _paths(spark, several.select("conv", "at", "cost", "rank"), fan_bits))
        rest = [c for c in blocks.columns if c not in ("cost", "rank", "exit", "total")]
        whole = blocks.filter("whole").select(*rest, F.lit(0).alias("entry"), "exit", "total")
        found = whole.unionByName(several.select(rest).join(states, ["conv", "at"]).select(*rest, "entry", "exit", "total"))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "kinds")
        #: A row for each block, with the edits of its turns.
        self.blocks = kept(spark, found.mapInArrow(_edits, f"{schema}, {_EDITS}"))

    def report(self) -> DataFrame:
        """conv, n, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation that has turns; tail: the inserts at its end."""
        part = F.struct("at", F.array_join("edits", "").alias("audit"), "first", "last", "first_turn", "last_turn", "exit")
        sums = [F.sum(c).alias(c) for c in ("n", "blank", "duplicate", "truncated", "illegal", "turns")]
        d = self.blocks.groupBy("conv").agg(*sums, F.min("first_turn").alias("lo"), F.max("last_turn").alias("hi"), F.first("total").alias("cost"), F.array_sort(F.collect_list(part)).alias("parts"))
        pairs = F.arrays_zip(F.slice("parts", F.lit(1), F.size("parts") - 1).alias("a"), F.slice("parts", F.lit(2), F.size("parts")).alias("b"))
        code = lambda p: p["a"]["last"] * 4 + p["b"]["first"]
        bad = F.size(F.filter(pairs, lambda p: ~code(p).isin(1, 6, 9)))
        shared = F.size(F.filter(pairs, lambda p: p["a"]["last_turn"] == p["b"]["first_turn"]))
        tail = F.element_at(F.array(F.lit(""), F.lit("II"), F.lit("I"), F.lit("")), F.element_at("parts", -1)["exit"] + 1)
        return d.select(
            "conv",
            "n",
            F.coalesce(F.col("hi") - F.col("lo") + 1 - (F.col("turns") - shared), F.lit(0)).cast("long").alias("gaps"),
            "blank",
            "duplicate",
            "truncated",
            (F.col("illegal") + bad).cast("long").alias("illegal"),
            "cost",
            F.concat(F.array_join(F.transform("parts", lambda p: p["audit"]), ""), tail).alias("audit"),
            tail.alias("tail"),
        )

    def kept_turns(self) -> DataFrame:
        """conv, at, place_in_block, edit, role, turn, text of every turn that stays, with its new role; ``inserted``: roles of the turns put before it."""
        d = self.blocks.select("conv", "at", "whole", "states", F.posexplode(F.arrays_zip("rows", "edits")).alias("i", "x"))
        state = F.conv(F.hex(F.substring("states", F.col("i") + 1, F.lit(1))), 16, 10).cast("int")
        d = d.select("conv", "at", "whole", "i", state.alias("state"), F.col("x.rows.turn").alias("turn"), F.coalesce(F.col("x.rows.turn").cast("string"), F.lit("")).alias("place"), F.col("x.rows.role").alias("role"), F.col("x.rows.key").alias("key"), F.col("x.edits").alias("edit")).filter("not endswith(edit, 'D')")
        texts = self.rows.groupBy("conv", "place", "role", "key").agg(F.first("text").alias("text"))
        d = d.join(texts, ["conv", "place", "role", "key"])
        inserts = F.length("edit") - 1
        now = F.when(F.endswith("edit", F.lit("R")), _role(inserts, F.col("state"))).otherwise(F.col("role"))
        return d.select("conv", "at", "whole", "i", "turn", "edit", now.alias("role"), "text", _inserted(inserts, F.col("state")).alias("inserted"))

    def turns(self) -> DataFrame:
        """The repaired table: conv_id, position (which rises within a conversation, with gaps), turn (null if inserted), role, text and edit (K, R or I)."""
        null = lambda kind: F.lit(None).cast(kind)
        new = F.transform("inserted", lambda r: F.struct(null("long").alias("turn"), r.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
        old = F.array(F.struct("turn", "role", "text", F.right("edit", F.lit(1)).alias("edit")))
        d = self.kept_turns().select("conv", F.struct("at", "i").alias("p"), F.posexplode(F.concat(new, old)).alias("j", "x"))
        end = self.report().filter("tail <> ''").select("conv", F.struct(F.lit(2**62).alias("at"), F.lit(0).alias("i")).alias("p"), F.posexplode(_inserted(F.length("tail"), 3 - F.length("tail"))).alias("j", "r"))
        end = end.select("conv", "p", "j", F.struct(null("long").alias("turn"), F.col("r").alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")).alias("x"))
        return d.unionByName(end).select(conv_id().alias("conv_id"), F.struct("p.at", "p.i", "j").alias("position"), "x.*")

    def hashes(self) -> DataFrame:
        """conv and sha256 of the repaired ``role:text`` lines of every conversation where some turn stays.

        Lines are joined within a block; a conversation of one block is hashed
        there, the blocks of others go through the hash in their order.
        """
        lines = F.concat(F.transform("inserted", lambda r: F.concat(r, F.lit(":"))), F.array(F.concat("role", F.lit(":"), "text")))
        piece = F.struct("i", F.array_join(lines, "\n").alias("line"))
        b = self.kept_turns().groupBy("conv", "at", "whole").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["line"]), "\n").alias("piece"))
        tails = self.report().select("conv", F.when(F.col("tail") == "I", "\nassistant:").when(F.col("tail") == "II", "\nuser:\nassistant:").otherwise("").alias("ending"))
        b = b.join(tails, "conv")
        one = b.filter("whole").select("conv", F.sha2(F.encode(F.concat("piece", "ending"), "UTF-8"), 256).alias("sha256"))
        many = b.filter("not whole").select("conv", "at", F.encode("piece", "UTF-8").alias("piece"), F.encode("ending", "UTF-8").alias("ending"))
        return one.unionByName(many.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(_hashed, "conv string, sha256 string"))


def conv_id() -> Column:
    return F.when(F.col("conv") != "", F.col("conv").cast("long"))


def _role(inserts: Column, state: Column) -> Column:
    """The role that comes next after some inserts from a state: after u an assistant, else a user, by turns."""
    return F.when((inserts + (state == 2).cast("int")) % 2 == 1, "assistant").otherwise("user")


def _inserted(n: Column, state: Column) -> Column:
    """Roles of n inserted turns from a state."""
    both = F.array_repeat(F.lit(0), n)
    return F.transform(both, lambda _, i: _role(i, state))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation from its blocks in order; one block is held at a time."""
    conv = digest = ending_ = None

    def row() -> pa.RecordBatch:
        digest.update(ending_)
        return pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], names=["conv", "sha256"])

    for b in batches:
        for c, p, e in zip(*(b.column(x) for x in ("conv", "piece", "ending")), strict=True):
            if c.as_py() != conv:
                if digest is not None:
                    yield row()
                conv, digest, ending_ = c.as_py(), hashlib.sha256(), e.as_py()
            else:
                digest.update(b"\n")
            digest.update(p.as_py())
    if digest is not None:
        yield row()


def repaired(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The turns of all conversations after the cheapest repair; see Repair.turns."""
    return Repair(spark, conversations).turns()


def digests(spark: SparkSession, conversations: DataFrame, turns: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """What the repair of ``turns`` found, for every conv_id of ``conversations``: counts of faults, cost, audit, and the hash of the repaired conversation."""
    r = Repair(spark, turns, fan_bits)
    every = only(conversations, conv_id="long").select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")).distinct()
    d = every.join(r.report(), "conv", "left").join(r.hashes(), "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return d.select(conv_id().alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
