"""Prefix trie of conversations in double arrays.

A turn is named by the SHA-256 digest of its role and text together with its
length, a conversation is the binary string of its turns' names. Equal
conversations become one weighted row before anything else, so a group of
copies costs one row. The distinct conversations are range-partitioned in
byte order: a partition is a prefix shard, whose turns get dense ids. In a
shard all conversations are inserted level by level into a double-array trie
(the children of a state lie at ``BASE[state] + turn id`` and name their
parent in ``CHECK``), and walked through it to add up members.

Nodes of a shard that no other shard can hold are finished there. Only the
paths to a shard's first and last conversation may go on in its neighbours;
they leave the shard as partial aggregates, and neighbouring shards' paths are
merged in rounds of ``FAN`` shards to a task until one run is left: nodes of
both paths are added up, and nodes that fell behind are finished.

Defined results for odd input: a null role or text counts as empty; a null
turn comes first, and turns with equal numbers are ordered by length and
digest. Rows with a null ``conv_id`` belong to no conversation and take no
part. Repeated rows are turns of their own. An empty table has no node, not
even the root. Texts of any length are only hashed and measured. Other columns
are ignored. A conversation is one row of 36 bytes for each turn, so a single
conversation may have tens of millions of turns, not billions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from .registry import query
from .store import written

#: Bytes that name a turn: a SHA-256 digest, and the text's code points as a big-endian integer.
NAME, DIGEST = 36, 32
#: Shards whose border paths meet in one merging task.
FAN = 64
#: Conversation ids that one piece of an end list holds.
PIECE = 1 << 16
#: Turns of different conversations that a shard holds, about.
SHARD_TURNS = 1 << 18
#: Trials before a state's children are put behind all others.
TRIALS = 64
NONE_SHA = hashlib.sha256(b"").hexdigest()

NODE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
NODE_NAMES = [n for n, _ in NODE]


# --- conversations as binary strings of turn names ---------------------------------------

def sequences(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id and ``seq``, its turns' names in order."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    name = F.concat(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256),
                    F.lpad(F.hex(F.char_length(text)), 2 * (NAME - DIGEST), "0"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").isNotNull().alias("known"), "turn", F.char_length(text).alias("long"), name.alias("name")).alias("t"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return lists.select("conv_id", F.unhex(F.array_join(F.transform("ts", lambda t: t["name"]), "")).alias("seq"))


def with_shared_heads(convs: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Each conversation with its first ``crc32(conv_id) % most`` turns taken from the first conversation of its block."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int") * NAME
    donors = convs.where(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("donor"), F.substring("seq", F.lit(1), F.lit(most * NAME)).alias("head"))
    own = convs.select("conv_id", "seq", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("donor"))
    head = F.substring(F.coalesce("head", F.unhex(F.lit(""))), F.lit(1), F.col("h"))
    return own.join(donors, "donor", "left").select(
        "conv_id", F.concat(head, F.substring("seq", F.col("h") + 1, F.octet_length("seq"))).alias("seq"))


def end_lists(ends: DataFrame) -> DataFrame:
    """Per ``seq_id``: SHA-256 of its conversations' ids, ascending and comma-joined.

    Ids are range-partitioned with their sequence, so that a hot one spreads; each task joins its ids to pieces and
    one more task per sequence hashes the pieces in order, holding one at a time.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in ((0, pa.binary()), (1, pa.int64()), (2, pa.string()))],
                                              names=["seq_id", "first", "ids"])
        now, ids, done = None, [], []
        for batch in batches:
            for s, c in zip(batch.column("seq_id").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if s != now or len(ids) >= PIECE:
                    if ids:
                        done.append((now, ids[0], ",".join(map(str, ids))))
                    now, ids = s, []
                    if len(done) >= 1024:
                        yield packed(done)
                        done = []
                ids.append(c)
        if ids:
            done.append((now, ids[0], ",".join(map(str, ids))))
        if done:
            yield packed(done)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["seq_id", "ends"])
        for batch in batches:
            for s, text in zip(batch.column("seq_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if s != now:
                    if digest:
                        done.append((now, digest.hexdigest()))
                    now, digest = s, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if len(done) >= 1024:
                yield packed()
                done = []
        if digest:
            done.append((now, digest.hexdigest()))
        if done:
            yield packed()

    ranged = ends.repartitionByRange(partitions(ends), "seq_id", "conv_id").sortWithinPartitions("seq_id", "conv_id")
    parts = ranged.mapInArrow(pieces, "seq_id binary, first long, ids string")
    return parts.repartition("seq_id").sortWithinPartitions("seq_id", "first").select("seq_id", "ids").mapInArrow(hashed, "seq_id binary, ends string")


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """Per different conversation: ``seq``, ``n`` members, ``conv`` (the smallest member), ``ends``."""
    rows = written(convs.select("conv_id", "seq", F.unhex(F.sha2("seq", 256)).alias("seq_id")), "rebuilt")
    counts = written(rows.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv")), "members")
    # the row of the smallest member brings the sequence
    weighted = counts.join(rows.select(F.col("conv_id").alias("conv"), "seq"), "conv")
    shared = counts.where("n > 1").select("seq_id")
    listed = end_lists(rows.select("seq_id", "conv_id").join(shared, "seq_id", "left_semi"))
    return weighted.join(listed, "seq_id", "left").select(
        "seq", "n", "conv", F.coalesce("ends", F.sha2(F.col("conv").cast("string"), 256)).alias("ends"))


# --- one shard ---------------------------------------------------------------------------

class DoubleArray:
    """A trie over dense ids in two arrays; state 0 is the root."""

    def __init__(self, ids: int):
        self.base, self.check = np.zeros(ids + 16, dtype=np.int64), np.full(ids + 16, -1, dtype=np.int64)
        self.check[0] = 0
        self.free = list(range(ids + 17))  # the next free cell at or after each cell, by path halving
        self.free[0] = 1
        self.top = 1  # all cells from here on are free

    def _next(self, cell: int) -> int:
        free = self.free
        while free[cell] != cell:
            free[cell] = cell = free[free[cell]]
        return cell

    def _room(self, cells: int) -> None:
        have = len(self.base)
        if cells > have:
            more = max(cells, 2 * have) - have
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int64)])
            self.free.extend(range(have + 1, have + more + 1))

    def add(self, state: int, children: list[int]) -> None:
        """Give a childless state its children (ascending ids), in free cells."""
        low, rest = children[0], children[1:]
        cell = self._next(low)
        for trial in range(TRIALS + 1):
            if trial == TRIALS:
                cell = max(self.top, low)
            self._room(cell - low + children[-1] + 1)
            base = cell - low
            if all(self.check[base + c] < 0 for c in rest):
                break
            cell = self._next(cell + 1)
        self.base[state] = base
        for c in children:
            self.check[base + c] = state
            self.free[base + c] = base + c + 1
        self.top = max(self.top, base + children[-1] + 1)

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The states that the ids lead to (-1: none)."""
        cells = self.base[states] + ids
        inside = cells < len(self.check)
        return np.where(inside & (self.check[np.where(inside, cells, 0)] == states) & (cells > 0), cells, -1)


class Shard:
    """The trie of one shard's distinct conversations, given in byte order, with members added up."""

    def __init__(self, seqs: list[bytes], n: np.ndarray, conv: np.ndarray, ends: list[str]):
        self.sizes = np.array([len(s) // NAME for s in seqs], dtype=np.int64)
        self.names = np.frombuffer(bytearray().join(seqs), dtype=np.uint8).view(f"V{NAME}")
        self.offsets = np.cumsum(self.sizes) - self.sizes
        different, self.ids = np.unique(self.names, return_inverse=True)
        lengths = different.view(np.uint8).reshape(-1, NAME)[:, DIGEST:].astype(np.int64) @ (256 ** np.arange(3, -1, -1))
        self.trie = DoubleArray(len(different))
        state = np.zeros(len(seqs), dtype=np.int64)
        codes, self.levels = [], [np.zeros(1, dtype=np.int64)]
        paths = {0: [0], len(seqs) - 1: [0]}  # the states of the first and the last conversation
        walked = [(state.copy(), np.arange(len(seqs)))]
        for d in range(int(self.sizes.max())):
            live = np.flatnonzero(self.sizes > d)
            ids = self.ids[self.offsets[live] + d]
            order = np.lexsort((ids, state[live]))
            s, c = state[live][order], ids[order]
            new = np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]))
            s, c = s[new], c[new]
            cuts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            owners, children = s[cuts].tolist(), c.tolist()
            for i, (a, b) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), len(c)], strict=True)):
                self.trie.add(owners[i], children[a:b])
            state[live] = self.trie.step(state[live], ids)
            self.levels.append(self.trie.base[s] + c)
            codes.append(c)
            walked.append((state[live], live))
            for k, path in paths.items():
                if self.sizes[k] > d:
                    path.append(int(state[k]))
        cells = len(self.trie.check)
        self.parent = self.trie.check
        self.n, self.conv = np.zeros(cells, dtype=np.int64), np.full(cells, np.iinfo(np.int64).max)
        for at, live in walked:
            np.add.at(self.n, at, n[live])
            np.minimum.at(self.conv, at, conv[live])
        self.ends = dict(zip(state.tolist(), ends, strict=True))
        self.length = np.zeros(cells, dtype=np.int64)
        self.code = np.full(cells, -1, dtype=np.int64)
        for level, c in zip(self.levels[1:], codes, strict=True):
            self.length[level], self.code[level] = lengths[c], c
        self.different = different
        self.left, self.right = paths[0], paths[len(seqs) - 1]

    def finish(self, shard: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """Finished nodes, and the border paths as partial aggregates."""
        cells = len(self.n)
        border = np.zeros(cells, dtype=bool)
        border[self.left] = border[self.right] = True
        children, leaves, saved = (np.zeros(cells, dtype=np.int64) for _ in range(3))
        for level in reversed(self.levels[1:]):
            own = level[~border[level]]  # border nodes are added up when they are merged
            leaves[own] = np.where(children[own] == 0, 1, leaves[own])
            saved[own] += (self.n[own] - 1) * self.length[own]
            for total, part in ((children, 1), (leaves, leaves[own]), (saved, saved[own])):
                np.add.at(total, self.parent[own], part)
        depth = np.zeros(cells, dtype=np.int64)
        for d, level in enumerate(self.levels):
            depth[level] = d
        inner = np.concatenate([level[~border[level]] for level in self.levels])
        parent = self.parent[inner]
        keys = self._keys()
        open_parent = border[parent]
        done = [self.conv[inner], depth[inner], pa.array(self.conv[parent], mask=open_parent), self.n[inner], children[inner], leaves[inner],
                saved[inner], pa.array([self.ends.get(s, NONE_SHA) for s in inner.tolist()], pa.string()),
                pa.array([keys[s] if o else None for s, o in zip(parent.tolist(), open_parent.tolist(), strict=True)], pa.binary())]
        nodes = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in done], names=[*NODE_NAMES, "parent_key"])
        shared = sum(1 for a, b in zip(self.left, self.right, strict=False) if a == b)
        path = [(s, d, 0 if d >= shared else 2) for d, s in enumerate(self.left)] + [(s, d, 1) for d, s in enumerate(self.right) if d >= shared]
        at = np.array([s for s, _, _ in path])
        borders = pa.RecordBatch.from_arrays([
            pa.array([shard] * len(path), pa.int64()), pa.array([p for _, _, p in path], pa.int64()), pa.array([d for _, d, _ in path], pa.int64()),
            pa.array([keys[s] for s in at.tolist()], pa.binary()), pa.array(self.length[at]), pa.array(self.n[at]), pa.array(self.conv[at]),
            pa.array([self.ends.get(s) for s in at.tolist()], pa.string()), pa.array(children[at]), pa.array(leaves[at]), pa.array(saved[at])],
            names=[n for n, _ in BORDER])
        return nodes, borders

    def _keys(self) -> dict[int, bytes]:
        """A digest of the whole prefix for each border node: equal prefixes have equal keys in all shards."""
        keys = {0: b""}
        for path in (self.left, self.right):
            for a, b in zip(path, path[1:], strict=False):
                keys[b] = hashlib.sha256(keys[a] + self.different[self.code[b]].tobytes()).digest()
        return keys


#: A node on a border path; ``side``: 0 on the left path, 1 on the right one, 2 on both.
BORDER = [("shard", pa.int64()), ("side", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("length", pa.int64()), ("n", pa.int64()),
          ("conv", pa.int64()), ("ends", pa.string()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())]
_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def ddl(fields: list) -> str:
    return ", ".join(f"{name} {_SQL[kind]}" for name, kind in fields)


# --- merging the border paths ------------------------------------------------------------

class Open:
    """A border node that is not finished yet."""

    __slots__ = ("depth", "key", "length", "n", "conv", "ends", "children", "leaves", "saved")

    def __init__(self, *values):
        for name, value in zip(self.__slots__, values, strict=True):
            setattr(self, name, value)

    def absorb(self, other: Open) -> None:
        self.n += other.n
        self.conv = min(self.conv, other.conv)
        self.ends = self.ends or other.ends
        for name in ("children", "leaves", "saved"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def values(self) -> list:
        return [getattr(self, name) for name in self.__slots__]


class Merger:
    """Adjacent runs of shards joined from left to right; finished nodes go to ``done``."""

    def __init__(self):
        self.left: list[Open] = []
        self.right: list[Open] = []
        self.done: list[tuple] = []

    def _close(self, path: list[Open], above: int, keep: list[Open]) -> None:
        """Finish the nodes of ``path`` deeper than ``above`` that are not on ``keep`` too."""
        for d in range(len(path) - 1, above, -1):
            node = path[d]
            if d < len(keep) and keep[d] is node:
                break
            if not node.children:
                node.leaves = 1
            node.saved += (node.n - 1) * node.length
            parent = path[d - 1] if d else None
            if parent:
                parent.children += 1
                parent.leaves += node.leaves
                parent.saved += node.saved
            self.done.append((node.conv, node.depth, None, node.n, node.children, node.leaves, node.saved, node.ends or NONE_SHA,
                              parent.key if parent else None, node.key))

    def add(self, left: list[Open], right: list[Open]) -> None:
        """The next run to the right, by its border paths (shared nodes are the same objects)."""
        if not self.right:
            self.left, self.right = left, right
            return
        mine = self.right
        same = 0
        while same < min(len(mine), len(left)) and mine[same].key == left[same].key:
            same += 1
        self._close(mine, same - 1, self.left)
        self._close(left, same - 1, right)
        both = sum(1 for a, b in zip(left, right, strict=False) if a is b)
        for d in range(same):
            mine[d].absorb(left[d])
        # what the new run's right path has left behind is finished, unless it is on this run's left path
        stay = min(same, both)
        self._close(mine[:same], stay - 1, self.left)
        self.right = mine[:stay] + right[stay:]

    def finish(self) -> None:
        both = sum(1 for a, b in zip(self.left, self.right, strict=False) if a is b)
        self._close(self.right, both - 1, [])
        self._close(self.left, -1, [])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Open], list[Open]]]:
    """The border paths of each shard, from rows ordered by shard, depth and side."""
    now, left, right = None, [], []
    for batch in batches:
        for shard, side, *values in zip(*(batch.column(n).to_pylist() for n, _ in BORDER), strict=True):
            if shard != now:
                if left:
                    yield now, left, right
                now, left, right = shard, [], []
            node = Open(*values)
            if side in (0, 2):
                left.append(node)
            if side in (1, 2):
                right.append(node)
    if left:
        yield now, left, right


FINISHED = [*NODE, ("parent_key", pa.binary()), ("key", pa.binary())]


def merged_borders(borders: DataFrame) -> DataFrame:
    """The finished nodes of all border paths: columns of a node, ``parent_key`` and ``key``."""
    fields = [*FINISHED, *((f"b_{n}", t) for n, t in BORDER)]

    def task(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows(merger: Merger, group: int | None) -> Iterator[pa.RecordBatch]:
                out = [[*d, *[None] * len(BORDER)] for d in merger.done]
                merger.done = []
                if group is not None:
                    both = sum(1 for a, b in zip(merger.left, merger.right, strict=False) if a is b)
                    out += [[*[None] * len(FINISHED), group, 2 if d < both else 0, *x.values()] for d, x in enumerate(merger.left)]
                    out += [[*[None] * len(FINISHED), group, 1, *x.values()] for d, x in enumerate(merger.right) if d >= both]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])

            group, merger = None, Merger()
            for shard, left, right in _paths(batches):
                if group is not None and shard // FAN != group:
                    yield from rows(merger, group)
                    merger = Merger()
                group = shard // FAN
                merger.add(left, right)
                if len(merger.done) > 10_000:
                    yield from rows(merger, None)
            if group is not None:
                if last:
                    merger.finish()
                yield from rows(merger, None if last else group)
        return run

    spark = borders.sparkSession
    done = []
    while True:
        most = borders.agg(F.max("shard")).first()[0]
        last = most is None or most < FAN
        group = F.floor(F.col("shard") / FAN)
        dealt = borders.repartition(group) if not last else borders.coalesce(1)  # the last round: FAN runs at most
        out = written(dealt.sortWithinPartitions("shard", "depth", "side").mapInArrow(task(last), ddl(fields)), "merged")
        done.append(out.where("conv_id IS NOT NULL").select(*[n for n, _ in FINISHED]))
        if last:
            break
        borders = out.where("b_shard IS NOT NULL").select(*[F.col(f"b_{n}").alias(n) for n, _ in BORDER])
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return written(result, "border-nodes") if len(done) > 1 else result


# --- the whole trie ----------------------------------------------------------------------

def trie_nodes(sequences: DataFrame) -> DataFrame:
    """All nodes of the trie over ``distinct_sequences`` rows."""
    fields = [*NODE, ("parent_key", pa.binary()), ("shard", pa.int64()), *((f"b_{n}", t) for n, t in BORDER)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        trie = Shard(rows.column("seq").to_pylist(), rows.column("n").to_numpy(), rows.column("conv").to_numpy(), rows.column("ends").to_pylist())
        shard = TaskContext.get().partitionId()
        nodes, borders = trie.finish(shard)
        own = pa.array([shard] * nodes.num_rows, pa.int64())
        no_border = [pa.nulls(nodes.num_rows, t) for _, t in BORDER]
        no_node = [pa.nulls(borders.num_rows, t) for _, t in fields[:-len(BORDER)]]
        for columns in ([*nodes.columns, own, *no_border], [*no_node, *borders.columns]):
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])

    sequences = written(sequences, "distinct")
    turns = sequences.agg(F.sum(F.octet_length("seq").cast("long"))).first()[0] or 0
    shards = max(partitions(sequences), turns // NAME // SHARD_TURNS)
    ranged = sequences.repartitionByRange(shards, "seq").sortWithinPartitions("seq")
    # written with their shard: the border rows and the nodes of a shard come from one and the same run of its task
    out = written(ranged.mapInArrow(run, ddl(fields)), "shards")
    borders = out.where("b_shard IS NOT NULL").select(*[F.col(f"b_{n}").alias(n) for n, _ in BORDER])
    nodes = out.where("conv_id IS NOT NULL").select(*NODE_NAMES, "parent_key", "shard")
    upper = merged_borders(borders)
    # the smallest member of a border node is known only now; it goes to each shard that holds the node, and there to the children
    found = upper.select("key", F.col("conv_id").alias("found"))
    in_shards = borders.select("shard", F.col("key").alias("parent_key")).join(found.withColumnRenamed("key", "parent_key"), "parent_key")
    below = nodes.where("parent_key IS NOT NULL").join(in_shards, ["shard", "parent_key"], "left").withColumn("parent_conv_id", F.col("found"))
    above = upper.join(found.withColumnRenamed("key", "parent_key"), "parent_key", "left").withColumn("parent_conv_id", F.col("found"))
    return (nodes.where("parent_key IS NULL").select(NODE_NAMES).unionByName(below.select(NODE_NAMES)).unionByName(above.select(NODE_NAMES)))


def conversation_trie(turns: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    return trie_nodes(distinct_sequences(with_shared_heads(sequences(turns), block, most)))


@query("op12_prefix_trie", sql="""
WITH t AS (
  SELECT conv_id, list(row(coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, own, xor(4294967295::UBIGINT, list_reduce(
           list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]),
             lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))) % 6 AS h FROM t),
r AS (
  SELECT h.conv_id, list_concat(coalesce(d.own[1:h.h], []), h.own[h.h + 1:]) AS path
  FROM h LEFT JOIN t d ON d.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM r),
n AS (
  SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(path) = depth), '')) AS ends_sha256
  FROM p GROUP BY 1, 2),
k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n_convs - 1) * length(struct_extract(n.node[n.depth], 2)) ELSE 0 END AS own
  FROM n LEFT JOIN k ON k.node = n.node),
s AS (
  SELECT node[1:d] AS node, sum(own) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.node = m.node LEFT JOIN n up ON m.depth > 0 AND up.depth = m.depth - 1 AND up.node = m.node[1:m.depth - 1]""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))
