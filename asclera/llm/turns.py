"""Conversation repair: the cheapest edits that make the roles of a conversation alternate.

The roles must read ``(s?(ua)+)?``: four states. A conversation is a chain of rows in
the order of turns, cut into blocks of slowly growing length, so n rows make about
sqrt(2 n) blocks of at most sqrt(2 n) rows in each partition. Only the backward cost
vectors at block ends, the checkpoints, are stored. Blocks are then computed again,
each from its checkpoint, while edits are chosen forward.

So that the blocks of a very long conversation run side by side, a block first yields
its 4 x 4 cost matrix; a conversation's matrices give the checkpoints from its end, and
its blocks' edits for the four states they may be entered in are joined from its start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, text_session

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 60
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. 0 and 3 may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: State and role of an inserted or rewritten row.
OWN = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
LEGAL = {"su", "ua", "au"}
#: Rows of the first block of a chain; each later block has one more.
FIRST_BLOCK = 64

#: initial, whether it must be deleted, whether it is truncated, deletions that follow
Row = tuple[str, bool, bool, int]


def _closed(base: list[int]) -> list[int]:
    """Costs with rows inserted before."""
    at2, at3 = min(base[2], INSERT + base[3]), min(base[3], INSERT + base[2])
    return [min(base[0], INSERT + at2), min(base[1], INSERT + at2), at2, at3]


END = _closed([0, FAR, FAR, 0])


def _options(row: Row, state: int, after: list[int]) -> list[tuple[str, int, int]]:
    """(edit, state after it, cost with all that follows) of a row."""
    initial, must, truncated, more = row
    out = [("D", state, DELETE * (1 + more) + after[state])]
    if not must:
        extra = truncated * TRUNCATED + DELETE * more
        if initial in NEXT[state]:
            to = NEXT[state][initial]
            out.append(("K", to, KEEP + extra + after[to]))
        to = OWN[state][0]
        out.append(("R", to, REROLE + extra + after[to]))
    return out


def before(row: Row, after: list[int]) -> list[int]:
    """The backward cost vector before a row, from the one behind it."""
    return _closed([min(cost for _, _, cost in _options(row, s, after)) for s in range(4)])


def matrix(rows: list[Row]) -> list[int]:
    """Costs from each state before the rows to each state behind them, row by row of the matrix."""
    columns = []
    for end in range(4):
        costs = [FAR] * 4
        costs[end] = 0
        for row in reversed(rows):
            costs = [min(c, FAR) for c in before(row, costs)]
        columns.append(costs)
    return [columns[end][state] for state in range(4) for end in range(4)]


def walk(rows: list[Row], checkpoint: list[int], last: bool) -> tuple[list[str], list[int]]:
    """For each state before the rows the ASCII-least tight edits and the state behind them."""
    costs = [checkpoint]
    for row in reversed(rows):
        costs.append(before(row, costs[-1]))
    costs.reverse()
    audits, ends = [], []
    for state in range(4):
        edits = []
        for k, row in enumerate(rows):
            while True:
                found = [(e, to) for e, to, cost in _options(row, state, costs[k + 1]) if cost == costs[k][state]]
                if INSERT + costs[k][OWN[state][0]] == costs[k][state]:
                    found.append(("I", OWN[state][0]))
                edit, state = min(found)
                edits.append(edit)
                if edit != "I":
                    edits.append("D" * row[3])
                    break
        while last and state not in (0, 3):
            edits.append("I")
            state = OWN[state][0]
        audits.append("".join(edits))
        ends.append(state)
    return audits, ends


# Rows ---------------------------------------------------------------------------------

_BLANKS = " \t\n\x0b\x0c\r"


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def faulted(rows: DataFrame) -> DataFrame:
    """Equal rows (conv, turn, role, text) as one, with the row's faults and the deletions that follow it."""
    one = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    first = one.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(
        F.min(F.struct("turn")).alias("first"), F.count("*").alias("places")
    )
    again = first.filter("places > 1")
    keyed = one.withColumn("hash", F.sha2(F.col("text").cast("binary"), 256))
    joined = keyed.join(again, _same("conv", "c") & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h")), "left")
    last = F.substring(F.rtrim(F.col("text"), F.lit(_BLANKS)), -1, 1)
    blank = last == ""
    seen = ~blank & F.col("places").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    return joined.select(
        "conv", "turn", "role", "text", "hash", "copies",
        F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), seen.alias("seen"),
        (~blank & ~seen & ~last.isin(".", "!", "?")).alias("cut"),
    )


def laid_out(rows: DataFrame) -> DataFrame:
    """Rows in order with the block they are in, and for each block one row with its matrix and counts."""
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema.fields), *T.StructType.fromDDL(
        "part int, block bigint, place bigint, matrix array<bigint>, heads string, inner_illegal bigint, "
        "n_blank bigint, n_seen bigint, n_cut bigint, low bigint, high bigint, turns bigint"
    ).fields])
    names, own = schema.names, rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        conv, block, limit, held = object(), -1, FIRST_BLOCK, []  # held: (initial, must, cut, more, turn, blank, seen, copies)

        def summary() -> dict:
            illegal = sum(h[7] - 1 for h in held) + sum(a[0] + b[0] not in LEGAL for a, b in zip(held, held[1:]))
            turns = [h[4] for h in held if h[4] is not None]
            return {
                "conv": conv, "part": part, "block": block, "matrix": matrix([h[:4] for h in held]), "heads": f"{held[0][0]}\n{held[-1][0]}",
                "inner_illegal": illegal, "n_blank": sum(h[7] for h in held if h[5]),
                "n_seen": sum(h[7] if h[6] else 0 if h[5] else h[7] - 1 for h in held), "n_cut": sum(h[2] for h in held),
                "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
            }

        for batch in batches:
            ends, blocks, places = [], [], []
            columns = (batch.column(own.index(c)).to_pylist() for c in ("conv", "turn", "initial", "blank", "seen", "cut", "copies"))
            for key, turn, initial, blank, seen, cut, copies in zip(*columns):
                if key != conv or len(held) >= limit:
                    if held:
                        ends.append(summary())
                    limit = limit + 1 if key == conv else FIRST_BLOCK
                    conv, block, held = key, block + 1, []
                blocks.append(block)
                places.append(len(held))
                held.append((initial, blank or seen, cut, copies - 1, turn, blank, seen, copies))
            n = batch.num_rows
            kinds = dict(zip(names, to_arrow_types(schema)))
            made = {"part": pa.array([part] * n, pa.int32()), "block": pa.array(blocks, pa.int64()), "place": pa.array(places, pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) if c in own else made[c] if c in made else pa.nulls(n, kinds[c]) for c in names], names
            )
            if ends:
                yield pa.RecordBatch.from_pylist(ends, pa.schema([(c, kinds[c]) for c in names]))
        if held:
            kinds = dict(zip(names, to_arrow_types(schema)))
            yield pa.RecordBatch.from_pylist([summary()], pa.schema([(c, kinds[c]) for c in names]))

    order = ["conv", "turn", "role", "hash"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "turns")


def to_arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]


def _streamed(df: DataFrame, keys: list[str], order: list[Column], function, kind: T.StructType | str) -> DataFrame:
    """Apply ``function`` to the rows (as dictionaries) of each task, which has whole keys in the given order."""
    schema = kind if isinstance(kind, T.StructType) else T.StructType.fromDDL(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = pa.schema(list(zip(schema.names, to_arrow_types(schema))))
        out, size = [], 0
        for row in function(r for batch in batches for r in batch.to_pylist()):
            out.append(row)
            size += 64 + sum(len(v) for v in row.values() if isinstance(v, str))
            if len(out) >= 1000 or size >= 4 << 20:
                yield pa.RecordBatch.from_pylist(out, to)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, to)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*order).mapInArrow(run, schema)


def _typed(conv: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), *T.StructType.fromDDL(rest).fields])


class Repaired:
    """A repaired table: ``report`` has a row per conversation, ``messages`` one per message that is left."""

    def __init__(self, report: DataFrame, messages: DataFrame):
        self.report, self.messages = report, messages


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """Find the faults of every conversation and its cheapest edits.

    ``report``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. ``messages``:
    conv, part, block, place (their order), edit, role, text. Rows are taken by turn, null
    turns first, ties by role and the text's SHA-256. A null role or text counts as one blank;
    a role whose first letter is not s, u or a can only be rewritten or deleted. Rows without
    a conversation form one. Repeated rows are duplicates. Equal edits of least cost are
    taken by their initials D, I, K, R. Turns are whole numbers. Other columns are not read;
    an empty table gives no rows.
    """
    text_session(rows.sparkSession)
    blank = F.lit(" ")
    plain = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), blank).alias("role"), F.coalesce(F.col(text_col).cast("string"), blank).alias("text"),
    )
    laid = laid_out(faulted(plain))
    conv = laid.schema["conv"].dataType
    chains = laid.filter("matrix is not null")
    backward = [F.col("conv"), F.col("part").desc(), F.col("block").desc()]
    forward = [F.col("conv"), F.col("part"), F.col("block")]

    def checkpoints(blocks: Iterator[dict]) -> Iterator[dict]:
        key, costs = object(), END
        for r in blocks:
            last = r["conv"] != key
            if last:
                key, costs = r["conv"], END
            yield {"b_part": r["part"], "b_block": r["block"], "behind": costs, "last": last}
            m = r["matrix"]
            costs = [min(m[4 * s + e] + costs[e] for e in range(4)) for s in range(4)]

    marks = _streamed(chains.select("conv", "part", "block", "matrix"), ["conv"], backward, checkpoints, "b_part int, b_block bigint, behind array<bigint>, last boolean")

    def recomputed(found: Iterator[dict]) -> Iterator[dict]:
        at, held, mark = None, [], None
        for r in found:
            if (r["part"], r["block"]) != at:
                if held:
                    yield _walked(at, held, mark)
                at, held = (r["part"], r["block"]), []
            if r["behind"] is not None:
                mark = r
            else:
                held.append((r["initial"], r["blank"] or r["seen"], r["cut"], r["copies"] - 1))
        if held:
            yield _walked(at, held, mark)

    def _walked(at, held, mark) -> dict:
        audits, ends = walk(held, mark["behind"], mark["last"])
        return {"w_part": at[0], "w_block": at[1], "audits": audits, "ends": ends}

    light = laid.filter("matrix is null").select("part", "block", "place", "initial", "blank", "seen", "cut", "copies", F.lit(None).cast("array<bigint>").alias("behind"), F.lit(None).cast("boolean").alias("last"))
    heads = marks.select(F.col("b_part").alias("part"), F.col("b_block").alias("block"), F.lit(-1).cast("bigint").alias("place"), F.lit(None).cast("string").alias("initial"),
                         *[F.lit(None).cast("boolean").alias(c) for c in ("blank", "seen", "cut")], F.lit(None).cast("bigint").alias("copies"), "behind", "last")
    walked = _streamed(light.unionByName(heads), ["part", "block"], [F.col(c) for c in ("part", "block", "place")], recomputed, "w_part int, w_block bigint, audits array<string>, ends array<int>")

    counts = ("inner_illegal", "n_blank", "n_seen", "n_cut")

    def joined(blocks: Iterator[dict]) -> Iterator[dict]:
        key, state, high, head = object(), 0, None, ""
        for r in blocks:
            if r["conv"] != key:
                key, state, high, head = r["conv"], 0, None, None
            first, last = r["heads"].split("\n")
            illegal = r["inner_illegal"] + (head is not None and head + first not in LEGAL)
            turns = r["turns"] - (high is not None and r["low"] == high)
            audit, to = r["audits"][state], r["ends"][state]
            yield {**{c: r[c] for c in ("conv", "part", "block", "n_blank", "n_seen", "n_cut", "low", "high")}, "illegal": illegal, "turns": turns, "state": state, "audit": audit}
            state, head, high = to, last, r["high"] if r["high"] is not None else high

    whole = chains.select("conv", "part", "block", "heads", *counts, "low", "high", "turns").join(
        walked.select(F.col("w_part").alias("part"), F.col("w_block").alias("block"), "audits", "ends"), ["part", "block"]
    )
    chosen = stored(_streamed(whole, ["conv"], forward, joined, _typed(
        conv, "part int, block bigint, n_blank bigint, n_seen bigint, n_cut bigint, low bigint, high bigint, illegal bigint, turns bigint, state int, audit string"
    )), "edits")

    edits = lambda letter: F.length("audit") - F.length(F.replace("audit", F.lit(letter), F.lit("")))
    report = chosen.groupBy("conv").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        F.sum("n_blank").alias("blank"), F.sum("n_seen").alias("duplicate"), F.sum("n_cut").alias("truncated"), F.sum("illegal").alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "block", "audit"))), lambda x: x.audit), "").alias("audit"),
        F.sum(DELETE * edits("D") + INSERT * edits("I") + REROLE * edits("R")).alias("edit_cost"),
    )

    def applied(found: Iterator[dict]) -> Iterator[dict]:
        at, text, state, k, n = None, "", 0, 0, 0

        def message(edit: str, role: str, body: str) -> dict:
            return {"conv": owner, "part": at[0], "block": at[1], "place": n, "edit": edit, "role": role, "text": body}

        def inserted() -> Iterator[dict]:
            nonlocal state, k, n
            while k < len(text) and text[k] == "I":
                state, role = OWN[state]
                yield message("I", role, "")
                k, n = k + 1, n + 1

        owner = None
        for r in found:
            if r["audit"] is not None:
                if at is not None:
                    yield from inserted()
                at, owner, text, state, k, n = (r["part"], r["block"]), r["conv"], r["audit"], r["state"], 0, 0
                continue
            yield from inserted()
            edit = text[k]
            k += r["copies"]
            if edit != "D":
                state, role = (NEXT[state][r["role"][:1]], r["role"]) if edit == "K" else OWN[state]
                yield {**message(edit, role, r["text"]), "cut": r["cut"]}
                n += 1
        if at is not None:
            yield from inserted()

    full = laid.filter("matrix is null").select("conv", "part", "block", "place", "role", "text", "copies", "cut", F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("audit"))
    choice = chosen.select("conv", "part", "block", F.lit(-1).cast("bigint").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
                           F.lit(None).cast("bigint").alias("copies"), F.lit(None).cast("boolean").alias("cut"), "state", "audit")
    messages = stored(_streamed(full.unionByName(choice), ["part", "block"], [F.col(c) for c in ("part", "block", "place")], applied, _typed(
        conv, "part int, block bigint, place bigint, edit string, role string, text string, cut boolean"
    )), "messages")
    kept_cut = messages.filter("cut").groupBy(F.col("conv").alias("m_conv")).agg(F.count("*").alias("left_cut"))
    full_report = report.join(kept_cut, _same("conv", "m_conv"), "left").select(
        "conv", "gaps", "blank", "duplicate", "truncated", "illegal",
        (F.col("edit_cost") + TRUNCATED * F.coalesce("left_cut", F.lit(0))).alias("cost"), "audit",
    )
    return Repaired(full_report, messages.drop("cut"))


def digests(messages: DataFrame) -> DataFrame:
    """The SHA-256 of each conversation's ``role:text`` lines.

    A digest needs its conversation in order: one task reads it as a stream, a message
    at a time, whatever its length.
    """

    def run(found: Iterator[dict]) -> Iterator[dict]:
        key, state = object(), None
        for r in found:
            if state is None or r["conv"] != key:
                if state is not None:
                    yield {"conv": key, "repaired_sha256": state.hexdigest()}
                key, state, between = r["conv"], hashlib.sha256(), ""
            state.update(f"{between}{r['role']}:{r['text']}".encode())
            between = "\n"
        if state is not None:
            yield {"conv": key, "repaired_sha256": state.hexdigest()}

    order = [F.col(c) for c in ("conv", "part", "block", "place")]
    return _streamed(messages, ["conv"], order, run, _typed(messages.schema["conv"].dataType, "repaired_sha256 string"))


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20; nulls are one blank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    hurt = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fate.alias("fate"))
    return hurt.filter("fate <> 0").select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def contract(rows: DataFrame) -> DataFrame:
    """One row per conversation of the damaged table, also of those without rows left."""
    done = repair(damaged(rows))
    ids = rows.select("conv_id").distinct()
    found = ids.join(done.report, _same("conv_id", "conv"), "left").drop("conv").join(digests(done.messages), _same("conv_id", "conv"), "left")
    return found.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
