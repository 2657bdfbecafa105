"""The trie of conversation prefixes, with totals of every subtree.

Subtree totals are computed by time-forward processing. Nodes are sorted externally by reverse level order, deepest first; each node
takes the totals its children sent from a priority queue, and sends its own forward to its parent, whose turn comes later. The trie is
dealt into shards along parts that stay small: a part holds connected nodes of one class of size and one band of levels, so neither a
first turn that most conversations share nor a very long conversation makes a large part. Totals of the tops of parts then travel to
the parts above, lightest class and deepest band first.
"""

from __future__ import annotations

import contextlib
import hashlib
import heapq
import pickle
import tempfile
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.llm.tables import discard, written
from gustline.operators.ordered import ordered

# Fixed values of the rebuilt conversations: they share openings in groups of this many ids, up to 5 turns long.
GROUP, OPENINGS = 100, 6

# A part holds nodes of BREADTH ** k up to BREADTH ** (k + 1) conversations and of this many levels: at most BREADTH * LEVELS nodes.
BREADTH, LEVELS = 128, 1_024
# Messages that a priority queue keeps in memory; more are spilled in sorted runs.
QUEUE_MESSAGES = 500_000
# Turns whose fingerprints are chained within one window.
BLOCK = 512
# Nodes of more than BREADTH conversations are broadcast up to this many (40 bytes each).
BROADCAST_NODES = 1_000_000
# Conversation ids per piece of text that is hashed.
IDS_PER_PIECE = 256


# ---- rebuilt conversations ---------------------------------------------------------------------------------------------


def opening_length(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its group."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % OPENINGS).cast("int")


def rebuilt_turns(df: DataFrame) -> DataFrame:
    """``c, pos, role, text``: the turns of every conversation of ``df(conv_id, turn, role, text)`` behind the opening of its group.

    Conversation c gets the first h turns of conversation c - c % 100 (``%`` keeps the sign of c) and its own turns after its first h.
    Turns are ordered by turn (NULL first), then role and text; a NULL role or text is an empty one; rows without ``conv_id`` take no
    part; repeated rows are turns of their own. A conversation without turns left has no row.
    """
    turns = df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("c"),
        F.col("turn").alias("t"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    own = ordered(turns, ["c"], ["t", "role", "text"]).running_sum("pos", F.lit(1)).done()
    own = own.withColumn("base", F.col("c") - F.col("c") % GROUP).withColumn("h", opening_length(F.col("c")))
    first = own.where((F.col("c") == F.col("base")) & (F.col("pos") < OPENINGS))
    lengths = first.groupBy("base").agg(F.max("pos").alias("n"))
    tails = own.where("pos > h").join(lengths, "base", "left")
    tails = tails.withColumn("pos", F.col("pos") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0))))
    convs = own.select("c", "base", "h").distinct()
    heads = convs.join(first.select("base", "pos", "role", "text"), "base").where("pos <= h")
    columns = ["c", "pos", "role", "text"]
    return heads.select(*columns).unionByName(tails.select(*columns))


def prefix_rows(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``c, depth, ka, kb, pa, pb, chars``: one row per conversation and prefix, the empty one included.

    A prefix is known by two 64-bit fingerprints (``ka, kb``) of its turns and their places; ``pa, pb`` are those without the last turn.
    Fingerprints of a prefix are combined by exclusive or, in blocks of turns, so that a long conversation is not one window.
    """
    parts = [F.col("pos"), F.col("role"), F.col("text")]
    turns = turns.select(
        "c",
        F.col("pos").alias("depth"),
        F.xxhash64(F.lit(11), *parts).alias("ha"),
        F.xxhash64(F.lit(47), *parts).alias("hb"),
        F.char_length("text").cast("bigint").alias("chars"),
        F.expr(f"(pos - 1) div {BLOCK}").alias("block"),
    )
    turns = written(turns, "turns")
    in_block = "OVER (PARTITION BY c, block ORDER BY depth)"
    before = "OVER (PARTITION BY c ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    blocks = turns.groupBy("c", "block").agg(F.bit_xor("ha").alias("ha"), F.bit_xor("hb").alias("hb"))
    blocks = blocks.select("c", "block", F.expr(f"bit_xor(ha) {before}").alias("oa"), F.expr(f"bit_xor(hb) {before}").alias("ob")).where("block > 0")
    rows = turns.withColumns({"ka": F.expr(f"bit_xor(ha) {in_block}"), "kb": F.expr(f"bit_xor(hb) {in_block}")})
    rows = rows.join(blocks, ["c", "block"], "left")
    ka, kb = F.col("ka").bitwiseXOR(F.coalesce("oa", F.lit(0))), F.col("kb").bitwiseXOR(F.coalesce("ob", F.lit(0)))
    rows = rows.select("c", "depth", ka.alias("ka"), kb.alias("kb"), ka.bitwiseXOR(F.col("ha")).alias("pa"), kb.bitwiseXOR(F.col("hb")).alias("pb"), "chars")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    roots = convs.select("c", zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), none.alias("pa"), none.alias("pb"), zero.alias("chars"))
    return rows.unionByName(roots)


# ---- conversations that end at a node ----------------------------------------------------------------------------------


def _id_pieces(batches, most: int):
    """Ids in order, joined while they belong to one node, at most so many."""
    node, first, ids = None, None, []

    def piece():
        arrays = [pa.array([x], pa.int64()) for x in (*node, first)] + [pa.array([",".join(ids)], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["depth", "ka", "kb", "first", "ids"])

    for batch in batches:
        out = []
        for *key, c in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if key != node or len(ids) == most:
                if ids:
                    out.append(piece())
                node, first, ids = key, c, []
            ids.append(str(c))
        yield from out
    if ids:
        yield piece()


def _hashes(batches):
    """SHA-256 of the pieces of each node, joined; a node's pieces stream through, they are never held together."""
    node, state = None, None

    def row():
        arrays = [pa.array([x], pa.int64()) for x in node] + [pa.array([state.hexdigest()], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["depth", "ka", "kb", "ends_sha256"])

    for batch in batches:
        out = []
        for *key, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
            if key != node:
                if state is not None:
                    out.append(row())
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield from out
    if state is not None:
        yield row()


def ends_digest(rows: DataFrame) -> DataFrame:
    """``depth, ka, kb, ends_sha256`` of the nodes where conversations end."""
    last = rows.groupBy("c").agg(F.max(F.struct("depth", "ka", "kb")).alias("x")).select("x.depth", "x.ka", "x.kb", "c")
    last = written(last, "ends")
    pieces = last.repartitionByRange("ka", "kb", "depth", "c").sortWithinPartitions("ka", "kb", "depth", "c")
    pieces = pieces.mapInArrow(partial(_id_pieces, most=IDS_PER_PIECE), "depth bigint, ka bigint, kb bigint, first bigint, ids string")
    pieces = pieces.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "depth", "first")
    return pieces.mapInArrow(_hashes, "depth bigint, ka bigint, kb bigint, ends_sha256 string")


# ---- time-forward processing -------------------------------------------------------------------------------------------


class MessageQueue:
    """A priority queue of ``(time, ...)`` tuples that spills to runs on the disk of its task, read back one message at a time.

    A run is a file without a name: it is gone with the task, and a task that is run again starts anew.
    """

    def __init__(self, limit: int = QUEUE_MESSAGES):
        self.limit, self.heap, self.runs, self.files = limit, [], [], contextlib.ExitStack()
        self.spilled = self.made = 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        # the half that is needed later goes; a sorted list is a heap
        self.heap.sort()
        keep = len(self.heap) // 2
        file = self.files.enter_context(tempfile.TemporaryFile())
        for message in self.heap[keep:]:
            pickle.dump(message, file, pickle.HIGHEST_PROTOCOL)
        self.spilled += len(self.heap) - keep
        del self.heap[keep:]
        file.seek(0)
        self.made += 1
        self._next_of(file, self.made)

    def _next_of(self, file, number: int) -> None:
        with contextlib.suppress(EOFError):
            heapq.heappush(self.runs, (pickle.load(file), number, file))  # noqa: S301 - a file of this task

    def pop_at(self, time: tuple):
        """All messages for ``time``, the earliest there is."""
        n = len(time)
        while True:
            if self.heap and self.heap[0][:n] == time:
                yield heapq.heappop(self.heap)
            elif self.runs and self.runs[0][0][:n] == time:
                message, number, file = heapq.heappop(self.runs)
                self._next_of(file, number)
                yield message
            else:
                return

    def close(self) -> None:
        self.files.close()


_NODE = (
    "depth bigint, ka bigint, kb bigint, pa bigint, pb bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, chars bigint, "
    "ends_sha256 string, cls int, band bigint, is_top boolean"
)
_TOTALS = "n_children bigint, n_leaves bigint, saved_tokens bigint"
_FIELDS = [field.strip().split(" ")[0] for field in _NODE.split(",")]


def _forward(batches, queued: int):
    """Totals of the nodes of a shard, which come deepest first; the queue keeps ``queued`` messages in memory."""
    queue = MessageQueue(queued)
    used = [_FIELDS.index(x) for x in ("depth", "ka", "kb", "pa", "pb", "n_convs", "chars", "is_top")]
    given = [len(_FIELDS) + i for i in range(3)]
    try:
        for batch in batches:
            totals = []
            for depth, ka, kb, pa_, pb, n, chars, is_top, children, leaves, saved in zip(
                *[batch.column(i).to_pylist() for i in (*used, *given)], strict=True
            ):
                for message in queue.pop_at((-depth, ka, kb)):
                    children += 1
                    leaves += message[3]
                    saved += message[4]
                leaves = leaves or 1
                saved += (n - 1) * chars
                totals.append((children, leaves, saved))
                if not is_top:
                    queue.push((1 - depth, pa_, pb, leaves, saved))
            columns = [pa.array(x, pa.int64()) for x in zip(*totals, strict=True)] if totals else [pa.array([], pa.int64())] * 3
            names = [*_FIELDS, "n_children", "n_leaves", "saved_tokens"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(_FIELDS)], *columns], names)
    finally:
        queue.close()


def _class_of(n: Column) -> Column:
    """0 up to BREADTH, 1 up to its square, and so on."""
    level, bound = F.lit(0), BREADTH
    while bound < 1 << 62:
        level = level + F.when(n > bound, 1).otherwise(0)
        bound *= BREADTH
    return level.cast("int")


def _in_parts(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes with the part they belong to: ``cls, band``, and the fingerprint ``ta, tb`` of the part's top."""
    nodes = nodes.withColumns({"cls": _class_of(F.col("n_convs")), "band": F.expr(f"depth div {LEVELS}")})
    heavy = written(nodes.where("cls > 0").select("depth", "ka", "kb", "cls"), "heavy")
    side = F.broadcast(heavy) if heavy.count() <= BROADCAST_NODES else heavy
    on_way = rows.select("c", "depth", "ka", "kb").join(side, ["depth", "ka", "kb"], "left")
    on_way = on_way.withColumns({"cls": F.coalesce("cls", F.lit(0)), "band": F.expr(f"depth div {LEVELS}")})
    # along a conversation the class only falls, so a class and band is one stretch of it
    tops = on_way.groupBy("c", "cls", "band").agg(F.min(F.struct("depth", "ka", "kb")).alias("top"))
    tops = tops.select(F.col("c").alias("conv_id"), "cls", "band", F.col("top.depth").alias("td"), F.col("top.ka").alias("ta"), F.col("top.kb").alias("tb"))
    found = nodes.join(tops, ["conv_id", "cls", "band"])
    return found.withColumn("is_top", F.expr("td = depth"))


def subtree_totals(tree: DataFrame) -> DataFrame:
    """``tree`` with ``n_children, n_leaves, saved_tokens``, part by part from the leaves up.

    Every step reads the nodes of one class and band, adds what the tops of finished parts sent to them, and writes their totals, so a lost
    executor costs a step at most. There are as many steps as classes and bands: a handful unless conversations have thousands of turns.
    """
    steps = sorted(tree.select("cls", "band").distinct().collect(), key=lambda r: (r.cls, -r.band))
    done: list[DataFrame] = []
    zero = F.lit(0).cast("bigint")
    for step in steps:
        part = tree.where((F.col("cls") == step.cls) & (F.col("band") == step.band))
        sent = [x.where(f"is_top and depth > 0 and (depth - 1) div {LEVELS} = {step.band}") for x in done]
        if sent:
            inbox = sent[0]
            for more in sent[1:]:
                inbox = inbox.unionByName(more)
            inbox = inbox.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb"))
            inbox = inbox.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
            part = part.join(inbox, ["depth", "ka", "kb"], "left").fillna(0, ["n_children", "n_leaves", "saved_tokens"])
        else:
            part = part.withColumns(dict.fromkeys(("n_children", "n_leaves", "saved_tokens"), zero))
        part = part.repartition("ta", "tb").sortWithinPartitions(F.col("depth").desc(), "ka", "kb")
        part = part.select(*_FIELDS, "n_children", "n_leaves", "saved_tokens")
        part = part.mapInArrow(partial(_forward, queued=QUEUE_MESSAGES), f"{_NODE}, {_TOTALS}")
        done.append(written(part, "totals"))
    found = done[0] if done else tree.select(*_FIELDS).withColumns(dict.fromkeys(("n_children", "n_leaves", "saved_tokens"), zero))
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def prefix_trie(df: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations of ``df(conv_id, turn, role, text)``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (smallest member of the parent, NULL for the root), ``n_convs`` (members),
    ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. A member begins with the node's turns; ``saved_tokens`` sums, over
    the subtree, the members but one times the characters of the last turn.

    Odd cases are those of :func:`rebuilt_turns`; a conversation without turns is a member of the root and ends there. Very long texts
    count whole. An empty table, or one without ids, gives no row. Other columns, whatever their names, are not read.
    """
    df = df.select("conv_id", "turn", "role", "text")
    convs = df.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("c")).distinct()
    rows = written(prefix_rows(rebuilt_turns(df), convs), "prefixes")
    nodes = rows.groupBy("depth", "ka", "kb").agg(
        F.count("*").alias("n_convs"),
        F.min("c").alias("conv_id"),
        F.first("pa").alias("pa"),
        F.first("pb").alias("pb"),
        F.max("chars").alias("chars"),
    )
    nodes = written(nodes, "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    known = nodes.join(ends_digest(rows), ["depth", "ka", "kb"], "left").join(above, ["depth", "pa", "pb"], "left")
    known = known.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    tree = written(_in_parts(known, rows), "trie")
    discard(nodes, rows)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return subtree_totals(tree).select(*columns)
