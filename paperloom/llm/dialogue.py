"""Repair of conversations: the cheapest edits that make their turns alternate.

Roles count by their first letter, and those of a repaired conversation read
``(s?(ua)+)?``. An edit keeps a row (K, costs 0), gives it the role user or assistant
(R, 2), deletes it (D, 3; a must for blank and repeated rows) or inserts an empty row
of either role (I, 2); a truncated row that stays costs 1 more. Of the cheapest lists
of edits the one whose letters are least in ASCII order is made.

1. Equal rows of a turn are one row with a number, and rows are range-partitioned and
   sorted by conversation, turn, role and text, so that a conversation of any length
   spreads over tasks. Up to 4,096 consecutive rows of a conversation are a piece.
2. Costs: for each piece the least cost from each of four states before it to each
   state behind it. One pass over the pieces of a conversation, from its end, gives
   the cost to the end behind every piece, and a dynamic program in the piece the
   cost to the end at every node (row and state).
3. Path ranking by prefix doubling: arcs that lie on cheapest paths are optimal. Nodes
   are ranked by the first letter of the least audit that starts there, then by 2, 4,
   8, ... letters: ranks and pointers of twice the length are those of the node and of
   the node its pointer reaches, paired. Arcs of one node never share a letter, so one
   node ends each of these audits, and letter, then rank of the target selects the arc.
4. The pointers give the path from each entry state in logarithmic steps. A second
   pass over the pieces, forward, gives the state each piece is entered in.

The two passes read 20 numbers for a piece, so a task sees one row in 4,096 of the
largest conversation. A digest of a whole conversation is made from a sorted stream
that is never held as a whole.

Defined results: null roles and texts are one space; null turns come first; a null id
is a conversation of its own. Rows of one turn are in order of role and text. Turns
may be missing, repeated or negative. A text is read whole. Only the four columns are
read, so others cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.sources.durable import cut_lineage

WHITE = "\t\n\x0b\f\r "
#: Rows of a piece: two to this power.
PIECE_BITS = 12
#: Rows whose nodes are in memory at once.
AT_ONCE = 1 << 16
#: Characters of a text that deal rows of one turn and role to tasks; all of it sorts them.
RANGE_CHARS = 64

# States: nothing yet, behind a system row, behind a user row, behind an assistant row.
# A row's class is the state behind it: 1, 2, 3 for s, u, a, or 0.
ENTRY = 0
KEPT = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])  # state, class
MADE = np.array([2, 2, 3, 2])
#: Cost to the end behind the last row, by inserts, and how many of them.
END = (0, 4, 2, 0)
FINAL = (0, 2, 1, 0)
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
LETTERS = np.array(["D", "I", "K", "R"])
FAR = np.int64(1 << 60)


# --- one batch of pieces ---------------------------------------------------------


def _costs(tokens: np.ndarray, bounds: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost to the end at every node of the pieces, and the target of its optimal arc of each letter, or -1.

    A token is a row's class, plus 4 if it must go, plus 8 if it is truncated. The
    nodes of piece p, row i and state s are ``4 (bounds[p] + p + i) + s``; those
    behind the last row have no arcs.
    """
    n = np.diff(bounds)
    base = 4 * (bounds[:-1] + np.arange(len(n)))
    total = 4 * (int(bounds[-1]) + len(n))
    cost = np.zeros(total, dtype=np.int64)
    arcs = np.full((total, len(LETTERS)), -1, dtype=np.int64)
    states = np.arange(4)
    cost[(base + 4 * n)[:, None] + states] = after
    order = np.argsort(-n, kind="stable")
    lengths = n[order]
    for back in range(1, int(lengths[0]) + 1 if len(n) else 1):
        pieces = order[: np.searchsorted(-lengths, -back, side="right")]
        row = n[pieces] - back
        token = tokens[bounds[pieces] + row]
        here = (base[pieces] + 4 * row)[:, None]
        behind = cost[here + 4 + states]
        kind, must, cut = token & 3, (token & 4) > 0, CUT * ((token & 8) > 0)
        kept = KEPT[:, kind].T
        stay = np.where(must, FAR, cut)[:, None]
        keep = np.where(kept >= 0, np.take_along_axis(behind, np.maximum(kept, 0), axis=1), FAR) + stay
        rerole = behind[:, MADE] + REROLE + stay
        delete = behind + DELETE
        best = np.minimum(np.minimum(delete, keep), rerole)
        found = best
        for _ in range(2):  # two inserts are a whole exchange: more cannot help
            found = np.minimum(best, found[:, MADE] + INSERT)
        found = np.minimum(found, FAR)
        insert = found[:, MADE] + INSERT
        cost[here + states] = found
        targets = (here + 4 + states, here + MADE, here + 4 + np.maximum(kept, 0), here + 4 + MADE)
        for code, (price, to) in enumerate(zip((delete, insert, keep, rerole), targets)):
            arcs[here + states, code] = np.where((price == found) & (found < FAR), to, -1)
    return cost, arcs


def _ranked(arcs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Letter of the arc that begins each node's least audit, and pointers over 1, 2, 4, ... letters of it.

    Nodes without arcs have the letter -1 and point to themselves.
    """
    own, codes = np.arange(len(arcs)), np.arange(arcs.shape[1])
    there = arcs >= 0
    letter = np.where(there.any(axis=1), there.argmax(axis=1), -1)
    pointers = [np.where(letter >= 0, arcs[own, letter], own)]
    rank = letter + 1
    while True:
        far = pointers[-1]
        _, rank = np.unique(rank * (len(rank) + 5) + rank[far], return_inverse=True)
        twice = far[far]
        if np.array_equal(twice, far):
            break
        pointers.append(twice)
    weight = np.where(there, codes * len(arcs) + rank[arcs], np.iinfo(np.int64).max)
    return np.where(letter >= 0, weight.argmin(axis=1), -1), pointers


def _ends(nodes: np.ndarray, pointers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where the paths from ``nodes`` end and after how many letters."""
    steps = np.zeros(len(nodes), dtype=np.int64)
    for power in reversed(range(len(pointers))):
        there = pointers[power][nodes]
        on = pointers[0][there] != there
        nodes, steps = np.where(on, there, nodes), steps + (on << power)
    there = pointers[0][nodes]
    return there, steps + (there != nodes)


def _along(nodes: np.ndarray, steps: np.ndarray, pointers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the path and node before each letter of the paths from ``nodes``."""
    path = np.repeat(np.arange(len(nodes)), steps)
    step = np.arange(len(path)) - np.repeat(np.cumsum(steps) - steps, steps)
    at = nodes[path]
    for power, pointer in enumerate(pointers):
        at = np.where(step >> power & 1, pointer[at], at)
    return path, at


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a column of lists."""
    bounds = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces in runs of about AT_ONCE rows."""
    for batch in batches:
        ends = np.cumsum(batch.column("tokens").value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            after = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
            yield batch.slice(at, after - at)
            at = after


def _starts(bounds: np.ndarray) -> np.ndarray:
    return 4 * (bounds[:-1] + np.arange(len(bounds) - 1))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``first, costs``: 16 costs from each state before a piece to each behind it."""
    for batch in _sliced(batches):
        tokens, bounds = _lists(batch.column("tokens"))
        out = np.empty((batch.num_rows, 4, 4), dtype=np.int64)
        for end in range(4):
            after = np.full((batch.num_rows, 4), FAR)
            after[:, end] = 0
            out[:, :, end] = _costs(tokens, bounds, after)[0][_starts(bounds)[:, None] + np.arange(4)]
        costs = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), 16).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("first"), costs], names=["key", "first", "costs"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``first, exits``: the state behind each piece for each state before it, and the class of its last row."""
    for batch in _sliced(batches):
        tokens, bounds = _lists(batch.column("tokens"))
        after = _lists(batch.column("after"))[0].reshape(-1, 4)
        _, pointers = _ranked(_costs(tokens, bounds, after)[1])
        ends, _ = _ends((_starts(bounds)[:, None] + np.arange(4)).ravel(), pointers)
        exits = np.concatenate((ends.reshape(-1, 4) % 4, (tokens[bounds[1:] - 1] & 3)[:, None]), axis=1)
        exits = pa.FixedSizeListArray.from_arrays(pa.array(exits.ravel()), 5).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("first"), exits], names=["key", "first", "exits"])


_EDITS = T.ArrayType(T.StructType([T.StructField("edit", T.StringType()), T.StructField("role", T.StringType())]))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``place, edits, cost, illegal`` of each row: inserts before it, its own edit, and inserts at the end."""
    for batch in _sliced(batches):
        tokens, bounds = _lists(batch.column("tokens"))
        places, _ = _lists(batch.column("places"))
        after = _lists(batch.column("after"))[0].reshape(-1, 4)
        entry = batch.column("entry").to_numpy(zero_copy_only=False)
        final = batch.column("final").to_numpy(zero_copy_only=False)
        letter, pointers = _ranked(_costs(tokens, bounds, after)[1])
        starts = _starts(bounds) + entry
        ends, steps = _ends(starts, pointers)
        more = np.where(final, np.array(FINAL)[ends % 4], 0)
        path, at = _along(starts, steps, pointers)
        # Inserts at the end of a conversation belong to its last row.
        row = (at >> 2) - path
        code, state = letter[at], at % 4
        row = np.concatenate((row, np.repeat(bounds[1:] - 1, more)))
        code = np.concatenate((code, np.full(int(more.sum()), 1)))
        tail = [state for end, n in zip((ends % 4).tolist(), more.tolist()) for state in ([], [2], [1, 2])[n]]
        state = np.concatenate((state, np.array(tail, dtype=np.int64)))
        order = np.argsort(row, kind="stable")
        row, code, state = row[order], code[order], state[order]
        price = np.array([DELETE, INSERT, 0, REROLE])[code] + np.where(code >= 2, CUT * ((tokens[row] & 8) > 0), 0)
        role = np.where(MADE[state] == 2, "user", "assistant")
        made = (code == 1) | (code == 3)
        pairs = pa.StructArray.from_arrays(
            [pa.array(LETTERS[code], type=pa.string()), pa.array(role, type=pa.string(), mask=~made)], names=["edit", "role"]
        )
        offsets = np.searchsorted(row, np.arange(len(tokens) + 1)).astype(np.int32)
        kind = tokens & 3
        before = np.concatenate(([0], kind[:-1]))
        before[bounds[:-1]] = batch.column("before").to_numpy(zero_copy_only=False)
        legal = ((before == 1) & (kind == 2)) | ((before == 2) & (kind == 3)) | ((before == 3) & (kind == 2)) | (before < 0)
        columns = [
            pa.array(places),
            pa.ListArray.from_arrays(pa.array(offsets), pairs),
            pa.array(np.bincount(row, weights=price, minlength=len(tokens)).astype(np.int64)),
            pa.array((~legal).astype(np.int64)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["place", "edits", "cost", "illegal"])


# --- passes over the pieces of a conversation ------------------------------------


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs behind each piece, from pieces in order of conversation, last one first."""
    known, costs = object(), None
    for batch in batches:
        after, final = [], []
        matrices = _lists(batch.column("costs"))[0].reshape(-1, 4, 4)
        for key, matrix in zip(batch.column("key").to_pylist(), matrices):
            final.append(key != known)
            if key != known:
                known, costs = key, np.array(END, dtype=np.int64)
            after.append(costs.tolist())
            costs = np.minimum((matrix + costs).min(axis=1), FAR)
        columns = [batch.column("first"), pa.array(after, type=pa.list_(pa.int64())), pa.array(final)]
        yield pa.RecordBatch.from_arrays(columns, names=["first", "after", "final"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State before each piece and class of the row before it, from pieces in order; -1 where there is none."""
    known, state, last = object(), ENTRY, -1
    for batch in batches:
        entry, before = [], []
        exits = _lists(batch.column("exits"))[0].reshape(-1, 5)
        for key, exit_ in zip(batch.column("key").to_pylist(), exits.tolist()):
            if key != known:
                known, state, last = key, ENTRY, -1
            entry.append(state)
            before.append(last)
            state, last = exit_[state], exit_[4]
        columns = [batch.column("first"), pa.array(entry, type=pa.int64()), pa.array(before, type=pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["first", "entry", "before"])


# --- tables ----------------------------------------------------------------------


def placed_rows(conversations: DataFrame, *, copies: Column | None = None) -> DataFrame:
    """``key, turn, role, text, times, place`` and faults of the rows, written; ``place`` is their order.

    ``copies`` says how often each row counts. ``fault`` is blank, duplicate,
    truncated or null; of ``times`` equal rows it is the first one's, and the others
    are duplicates unless blank.
    """
    one_space = [F.coalesce(F.col(name), F.lit(" ")).alias(name) for name in ("role", "text")]
    rows = conversations.select(
        "key", F.col("turn").cast("bigint").alias("turn"), *one_space, (F.lit(1) if copies is None else copies).alias("times")
    )
    rows = rows.where("times > 0").groupBy("key", "turn", "role", "text").agg(F.sum("times").alias("times"))
    dealt = rows.repartitionByRange("key", "turn", "role", F.substring("text", 1, RANGE_CHARS))
    ordered = dealt.sortWithinPartitions("key", "turn", "role", "text").withColumn("place", F.monotonically_increasing_id())
    trimmed = F.rtrim("text", F.lit(WHITE))
    ordered = ordered.withColumn("blank", trimmed == "").withColumn("cut", ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"))
    mark = F.when(~F.col("blank"), F.md5(F.to_json(F.struct("key", "role", "text"))))
    return cut_lineage(ordered.withColumn("mark", mark), "rows")


def row_facts(placed: DataFrame) -> DataFrame:
    """``key, place, turn, times, token, fault`` of every row, written; tokens as for ``_costs``."""
    rows = placed.select("key", "place", "turn", "times", "role", "blank", "cut", "mark")
    said = rows.where(~F.col("blank"))
    first = said.groupBy("mark").agg(F.min("place").alias("first"))
    said = said.join(first, "mark").withColumn("again", F.col("place") > F.col("first")).drop("first")
    rows = said.unionByName(rows.where("blank").withColumn("again", F.lit(False)))
    kind = F.left(F.col("role"), F.lit(1))
    kind = F.when(kind == "s", 1).when(kind == "u", 2).when(kind == "a", 3).otherwise(0)
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    goes = F.when(F.col("blank") | F.col("again"), 4).otherwise(0)
    token = kind + goes + F.when(F.col("cut"), 8).otherwise(0)
    return cut_lineage(rows.select("key", "place", "turn", "times", token.alias("token"), fault.alias("fault")), "facts")


def edit_rows(facts: DataFrame, *, piece_bits: int = PIECE_BITS) -> DataFrame:
    """``place, edits, cost, illegal`` of every row, written: its edits in order, with the role that each gives."""
    key = facts.schema["key"].dataType.simpleString()
    piece = F.shiftright(F.col("place"), piece_bits)
    listed = F.array_sort(F.collect_list(F.struct("place", "token")))
    pieces = facts.groupBy("key", piece.alias("piece")).agg(listed.alias("rows"))
    pieces = pieces.select("key", F.col("rows.place").alias("places"), F.col("rows.token").cast("array<bigint>").alias("tokens"))
    pieces = cut_lineage(pieces.withColumn("first", F.col("places")[0]), "pieces")

    costs = pieces.select("key", "first", "tokens").mapInArrow(_matrices, f"key {key}, first bigint, costs array<bigint>")
    backward = costs.repartition("key").sortWithinPartitions("key", F.desc("first"))
    behind = backward.mapInArrow(_backward, "first bigint, after array<bigint>, final boolean")
    pieces = cut_lineage(pieces.join(behind, "first"), "pieces")

    exits = pieces.select("key", "first", "tokens", "after").mapInArrow(_exits, f"key {key}, first bigint, exits array<bigint>")
    forward = exits.repartition("key").sortWithinPartitions("key", "first")
    before = forward.mapInArrow(_forward, "first bigint, entry bigint, before bigint")
    schema = T.StructType(
        [T.StructField("place", T.LongType()), T.StructField("edits", _EDITS)]
        + [T.StructField(name, T.LongType()) for name in ("cost", "illegal")]
    )
    return cut_lineage(pieces.join(before, "first").drop("key", "first").mapInArrow(_edits, schema), "edits")


def repaired_rows(placed: DataFrame, edits: DataFrame) -> DataFrame:
    """``key, place, step, edit, times, turn, role, text``: every edit in order of place and step, with the row it leaves.

    Of equal rows of a turn all but the first are deleted by the last step of their place.
    """
    more = F.when(F.col("times") > 1, F.array(F.struct(F.lit("D").alias("edit"), F.lit(None).cast("string").alias("role"))))
    # Equal rows go right behind the first, before inserts at the end.
    own = F.expr("array_position(transform(edits, e -> e.edit = 'I'), false)").cast("int")
    listed = F.when(
        F.col("times") > 1,
        F.concat(F.slice("edits", F.lit(1), own), more, F.slice("edits", own + 1, F.size("edits"))),
    ).otherwise(F.col("edits"))
    rows = placed.select("key", "place", "turn", "role", "text", "times").join(edits.select("place", "edits"), "place")
    rows = rows.withColumn("own", own).withColumn("edits", listed)
    rows = rows.select("*", F.posexplode("edits").alias("step", "done"))
    edit = F.col("done.edit")
    times = F.when((F.col("step") == F.col("own")) & (F.col("times") > 1), F.col("times") - 1).otherwise(F.lit(1))
    return rows.select(
        "key",
        "place",
        "step",
        edit.alias("edit"),
        times.alias("times"),
        F.when(edit != "I", F.col("turn")).alias("turn"),
        F.coalesce("done.role", "role").alias("role"),
        F.when(edit == "I", "").otherwise(F.col("text")).alias("text"),
    )


def digests(repaired: DataFrame) -> DataFrame:
    """``key, audit, repaired_sha256``: all letters, and a hash of ``role:text`` lines, of each conversation in a stream."""
    key = repaired.schema["key"]
    schema = T.StructType([key, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, letters, total, empty = None, [], None, True

        def ended(kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([known], type=kind), pa.array(["".join(letters)]), pa.array([total.hexdigest()])]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        kind = None
        for batch in batches:
            kind = batch.column("key").type
            for name, edit, times, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "edit", "times", "role", "text"))):
                if total is None or name != known:
                    if total is not None:
                        yield ended(kind)
                    known, letters, total, empty = name, [], hashlib.sha256(), True
                letters.append(edit * times)
                if edit != "D":
                    total.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                    empty = False
        if total is not None:
            yield ended(kind)

    rows = repaired.repartition("key").sortWithinPartitions("key", "place", "step")
    return rows.select("key", "edit", "times", "role", "text").mapInArrow(read, schema)


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with ``key, turn, role, text``, some of them damaged by a checksum of id and turn, and how often each counts."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").alias("key"),
        "turn",
        (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("kind"),
        space("role").alias("role"),
        space("text").alias("text"),
    )
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    return rows.withColumns({"text": text, "role": role}), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)


def repair_query(conversations: DataFrame, *, piece_bits: int = PIECE_BITS) -> DataFrame:
    """Faults, cost, audit and a digest of the repaired text of every conversation, after damage."""
    rows, copies = damaged(conversations)
    placed = placed_rows(rows, copies=copies)
    facts = row_facts(placed)
    edits = edit_rows(facts, piece_bits=piece_bits)
    fault, more = F.col("fault"), F.col("times") - 1
    counted = facts.join(edits.select("place", "cost", "illegal"), "place").groupBy("key").agg(
        F.max("turn").alias("last"),
        F.min("turn").alias("least"),
        F.countDistinct("turn").alias("turns"),
        F.sum(F.when(fault == "blank", F.col("times")).otherwise(0)).alias("blank"),
        F.sum(F.when(fault == "duplicate", F.col("times")).when(fault == "blank", 0).otherwise(more)).alias("duplicate"),
        F.sum(F.when(fault == "truncated", 1).otherwise(0)).alias("truncated"),
        F.sum(F.col("illegal") + more).alias("illegal"),
        F.sum(F.col("cost") + DELETE * more).alias("cost"),
    )
    gaps = F.coalesce(F.col("last") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    counted = counted.withColumn("gaps", gaps).select("key", *counts)
    digest = digests(repaired_rows(placed, edits))
    all_ = conversations.select(F.col("conv_id").alias("key")).distinct()
    parts = all_.unionByName(counted, allowMissingColumns=True).unionByName(digest, allowMissingColumns=True)
    return parts.groupBy(F.col("key").alias("conv_id")).agg(
        *[F.coalesce(F.max(name), F.lit(0)).cast("bigint").alias(name) for name in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


REPAIR_SQL = r"""
with recursive given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
      string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''),
      lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295) % 20 as kind
  from conversations),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from given, unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) u(copy)),
numbered as (
  select *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as said,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
marked as (
  select *, said = '' as blank, left(role, 1) as r,
    row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    right(said, 1) not in ('.', '!', '?') as cut,
    lag(left(role, 1)) over (partition by conv_id order by i) as r0 from numbered),
faults as (
  select *, blank or again as gone, case when not blank and not again and cut then 1 else 0 end as more from marked),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (blank) as blank, count(*) filter (not blank and again) as duplicate, sum(more) as truncated,
    count(*) filter (r0 is not null and r0 || r not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from faults group by conv_id),
best as (
  select conv_id, n as i, {'c': 0, 'a': '', 't': ''} as s0, {'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} as s1,
    {'c': 2, 'a': 'I', 't': chr(10) || 'assistant:'} as s2, {'c': 0, 'a': '', 't': ''} as s3 from counted
  union all
  select conv_id, i - 1,
    list_min([b0, {'c': i2.c + 2, 'a': 'I' || i2.a, 't': u || i2.t}]),
    list_min([b1, {'c': i2.c + 2, 'a': 'I' || i2.a, 't': u || i2.t}]),
    i2,
    list_min([b3, {'c': b2.c + 2, 'a': 'I' || b2.a, 't': u || b2.t}])
  from (
    select *, list_min([b2, {'c': b3.c + 2, 'a': 'I' || b3.a, 't': v || b3.t}]) as i2
    from (
      select conv_id, i, chr(10) || 'user:' as u, chr(10) || 'assistant:' as v,
        list_min([{'c': s0.c + 3, 'a': 'D' || s0.a, 't': s0.t},
          case when not gone and r = 's' then {'c': s1.c + more, 'a': 'K' || s1.a, 't': line || s1.t} end,
          case when not gone and r = 'u' then {'c': s2.c + more, 'a': 'K' || s2.a, 't': line || s2.t} end,
          case when not gone then {'c': s2.c + 2 + more, 'a': 'R' || s2.a, 't': chr(10) || 'user:' || text || s2.t} end]) as b0,
        list_min([{'c': s1.c + 3, 'a': 'D' || s1.a, 't': s1.t},
          case when not gone and r = 'u' then {'c': s2.c + more, 'a': 'K' || s2.a, 't': line || s2.t} end,
          case when not gone then {'c': s2.c + 2 + more, 'a': 'R' || s2.a, 't': chr(10) || 'user:' || text || s2.t} end]) as b1,
        list_min([{'c': s2.c + 3, 'a': 'D' || s2.a, 't': s2.t},
          case when not gone and r = 'a' then {'c': s3.c + more, 'a': 'K' || s3.a, 't': line || s3.t} end,
          case when not gone then {'c': s3.c + 2 + more, 'a': 'R' || s3.a, 't': chr(10) || 'assistant:' || text || s3.t} end]) as b2,
        list_min([{'c': s3.c + 3, 'a': 'D' || s3.a, 't': s3.t},
          case when not gone and r = 'u' then {'c': s2.c + more, 'a': 'K' || s2.a, 't': line || s2.t} end,
          case when not gone then {'c': s2.c + 2 + more, 'a': 'R' || s2.a, 't': chr(10) || 'user:' || text || s2.t} end]) as b3
      from (
        select b.*, f.r, f.gone, f.more, f.text, chr(10) || f.role || ':' || f.text as line
        from best b join faults f on f.conv_id is not distinct from b.conv_id and f.i = b.i)))),
all_ids as (select distinct conv_id from conversations)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0) as illegal, coalesce(b.s0.c, 0)::bigint as cost,
  coalesce(b.s0.a, '') as audit, sha256(coalesce(b.s0.t[2:], '')) as repaired_sha256
from all_ids o left join counted c on c.conv_id is not distinct from o.conv_id
left join best b on b.conv_id is not distinct from o.conv_id and b.i = 0
"""
