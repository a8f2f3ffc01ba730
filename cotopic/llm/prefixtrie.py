"""Conversation prefixes as double-array tries.

A conversation is the sequence of its turns (role, text), a turn a 128-bit hash and a length. Equal sequences are one row with
their number and smallest id. Sequences are range-partitioned and sorted turn by turn, so a shard holds neighbouring prefixes, and a
task streams its shard in runs of about ``SHARD_TURNS`` turns. Each run becomes one double array: turns get dense ids in the order in which
the levels need them, a node is a slot, ``BASE[node] + turn`` is its child's slot and ``CHECK`` names the parent. Walking all
sequences through it level by level counts members; a sweep from the deepest level up sums leaves and shared tokens.

A prefix is one stretch of the sorted sequences, so only nodes on the paths of a run's first and last sequence can be in another run:
all others are finished inside the run. Those few shared upper nodes carry what the run found below them and are merged by their prefix hash.
Their subtrees are summed without recursion: each shared node is owned by one path, a path sums what it owns from its deep end, and a
node's total is the sum of its paths' values there.

At scale: a first turn that a third of all conversations share is only an upper node of many shards; copies of one conversation
are combined before the shuffle; the driver sees range samples of at most 64 turns a key. The ids of members that end at a node are
sorted by all tasks into strings of bounded size, and one task a node only hashes these.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotopic.llm.common import giving_back, table, written

GROUP = 5  # contract: conversations of one group of ids share turns of its first
SHARED_TURNS = 9  # contract: fewer turns than this are shared
SHARD_TURNS = 50_000
CHUNK = 1 << 18  # characters of ids in one string
RANGE_TURNS = 64
EMPTY = hashlib.sha256(b"").hexdigest()

FREE, ROOT = -1, -2


class DoubleArray:
    """A trie over sequences of dense codes (from 1); ``rows`` are sorted, so equal prefixes are neighbours."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, FREE, np.int64)
        self.check[0] = ROOT
        self.top = 1  # slots from here on are free
        state = np.zeros(len(sizes), np.int64)
        live = np.flatnonzero(sizes > 0)
        d = 0
        while len(live):
            s, c = state[live], codes[starts[live] + d]
            new = np.ones(len(live), bool)
            new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
            self._children(s[new], c[new])
            state[live] = self.base[s] + c
            d += 1
            live = live[sizes[live] > d]

    def _room(self, n: int) -> None:
        if n > len(self.check):
            more = max(n, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, np.int64)))
            self.check = np.concatenate((self.check, np.full(more, FREE, np.int64)))

    def _children(self, parent: np.ndarray, code: np.ndarray) -> None:
        """Slots for the children (parent, code); parents come in stretches."""
        first = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        count = np.diff(np.append(first, len(parent)))
        for a, k in zip(first[count > 1].tolist(), count[count > 1].tolist()):
            self._place(int(parent[a]), code[a:a + k])
        single = first[count == 1]
        if len(single):
            holes = np.flatnonzero(self.check[:self.top] == FREE)[:len(single)]
            fresh = np.arange(self.top, self.top + len(single) - len(holes))
            self._room(self.top + len(fresh))
            self.top += len(fresh)
            slots = np.concatenate((holes, fresh))
            self.base[parent[single]] = slots - code[single]
            self.check[slots] = parent[single]

    def _place(self, parent: int, codes: np.ndarray) -> None:
        """First fit: the lowest base at which all of a node's children meet free slots."""
        low, span = int(codes.min()), int(codes.max() - codes.min())
        free = np.flatnonzero(self.check[:self.top] == FREE)
        base = self.top - low
        step = max(1, (1 << 18) // len(codes))
        for a in range(0, len(free), step):
            at = free[a:a + step, None] + (codes - low)[None, :]
            fits = ((at >= self.top) | (self.check[np.minimum(at, self.top - 1)] == FREE)).all(axis=1)
            if fits.any():
                base = int(free[a + int(np.argmax(fits))]) - low
                break
        self._room(base + low + span + 1)
        self.top = max(self.top, base + low + span + 1)
        self.base[parent] = base
        self.check[base + codes] = parent

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each state by its code, -1 where there is none."""
        to = self.base[state] + code
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == state), to, -1)


def dense_codes(k1: np.ndarray, k2: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Ids from 1 of the distinct turns, in order of their first place when read level by level (siblings get near ids)."""
    if not len(k1):
        return np.zeros(0, np.int64)
    a = np.unique(k1, return_inverse=True)[1].astype(np.int64)
    b, bi = np.unique(k2, return_inverse=True)
    order = np.argsort(level, kind="stable")
    _, at, inverse = np.unique((a * len(b) + bi)[order], return_index=True, return_inverse=True)
    rank = np.empty(len(at), np.int64)
    rank[np.argsort(at, kind="stable")] = np.arange(1, len(at) + 1)
    codes = np.empty(len(order), np.int64)
    codes[order] = rank[inverse]
    return codes


_M = [(np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x94D049BB133111EB))]


def _chain(h: np.ndarray, k1: np.ndarray, k2: np.ndarray, lane: int) -> np.ndarray:
    """The hash of a prefix from its parent's (uint64) and its last turn's."""
    a, b = _M[lane]
    x = (h + a) ^ k1.view(np.uint64)
    for k in (k2.view(np.uint64), np.uint64(lane + 1)):
        x = (x ^ (x >> np.uint64(30))) * b
        x = (x ^ (x >> np.uint64(27))) * a + k
    return x ^ (x >> np.uint64(31))


_LONGS = ["batch", "id1", "id2", "parent1", "parent2", "depth", "bytes", "n", "first", "parent_first", "children", "leaves", "saved", "s1", "s2"]
_NODES = pa.schema([*[(c, pa.int64()) for c in _LONGS], ("shared", pa.bool_()), ("on_first", pa.bool_()), ("on_last", pa.bool_())])
NODES_DDL = ", ".join(f"{c} long" for c in _LONGS) + ", shared boolean, on_first boolean, on_last boolean"


def trie_nodes(keys: np.ndarray, sizes: np.ndarray, nbytes: np.ndarray, n: np.ndarray, first: np.ndarray, ends: np.ndarray, batch: int):
    """The nodes of one run of sorted distinct sequences as a record batch (``_NODES``).

    ``keys``: two longs a turn, all sequences one after the other; ``ends``: the two hashes of each whole sequence. A finished node has its
    final values; of a shared one ``children``, ``leaves`` and ``saved`` cover the finished part below it alone.
    """
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    k1, k2 = np.ascontiguousarray(keys[0::2]), np.ascontiguousarray(keys[1::2])
    level = np.arange(len(k1)) - np.repeat(starts, sizes)
    codes = dense_codes(k1, k2, level)
    trie = DoubleArray(codes, starts, sizes)
    slots = trie.top
    members, owner = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max)
    depth, size_of = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    h = np.zeros((2, slots), np.uint64)
    s1, s2, ended = np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.zeros(slots, bool)
    on = np.zeros((2, slots), bool)
    state, live, d = np.zeros(len(sizes), np.int64), np.arange(len(sizes)), 0
    while True:
        at = state[live]
        np.add.at(members, at, n[live])
        np.minimum.at(owner, at, first[live])
        done = live[sizes[live] == d]
        s1[state[done]], s2[state[done]], ended[state[done]] = ends[done, 0], ends[done, 1], True
        on[0, state[0]] = on[1, state[-1]] = True
        live = live[sizes[live] > d]
        if not len(live):
            break
        turn = starts[live] + d
        before = state[live]
        to = trie.step(before, codes[turn])
        if (to < 0).any():
            raise AssertionError("a sequence left its trie")
        depth[to], size_of[to] = d + 1, nbytes[turn]
        for lane in (0, 1):
            h[lane, to] = _chain(h[lane, before], k1[turn], k2[turn], lane)
        state[live] = to
        d += 1
    node = np.flatnonzero(trie.check[:slots] != FREE)
    parent = np.maximum(trie.check[:slots], 0)
    shared = on.any(axis=0)
    children, leaves, saved = np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    by_depth = node[np.argsort(depth[node], kind="stable")]
    cut = np.searchsorted(depth[by_depth], np.arange(d + 2))
    for k in range(d, 0, -1):  # deepest first: a level's nodes are settled before their parents
        x = by_depth[cut[k]:cut[k + 1]]
        x = x[~shared[x]]
        leaves[x[children[x] == 0]] = 1
        saved[x] += (members[x] - 1) * size_of[x]
        np.add.at(children, parent[x], 1)
        np.add.at(leaves, parent[x], leaves[x])
        np.add.at(saved, parent[x], saved[x])
    up = parent[node]
    values = {"batch": np.full(len(node), batch), "id1": h[0, node].view(np.int64), "id2": h[1, node].view(np.int64),
              "parent1": h[0, up].view(np.int64), "parent2": h[1, up].view(np.int64), "depth": depth[node], "bytes": size_of[node],
              "n": members[node], "first": owner[node], "children": children[node], "leaves": leaves[node], "saved": saved[node]}
    cols = {c: pa.array(v, pa.int64()) for c, v in values.items()}
    cols["parent_first"] = pa.array(owner[up], pa.int64(), mask=shared[up])
    cols["s1"], cols["s2"] = (pa.array(x[node], pa.int64(), mask=~ended[node]) for x in (s1, s2))
    cols |= {"shared": pa.array(shared[node]), "on_first": pa.array(on[0, node]), "on_last": pa.array(on[1, node])}
    return pa.RecordBatch.from_arrays([cols[f.name] for f in _NODES], schema=_NODES)


def _shards(limit: int):
    """Sorted rows ``keys, bytes, n, first, s1, s2`` of a shard to nodes, a run of about ``limit`` turns at a time."""
    def flat(column):
        return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()).astype(np.int64)

    def run(batches):
        from pyspark import TaskContext

        part, made, held, turns = TaskContext.get().partitionId(), 0, [], 0

        def nodes():
            keys, sizes, nbytes, rest = (list(x) for x in zip(*held))
            rest = np.concatenate(rest)
            return trie_nodes(np.concatenate(keys), np.concatenate(sizes) // 2, np.concatenate(nbytes), rest[:, 0], rest[:, 1], rest[:, 2:],
                              (part << 32) + made)

        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                some = batch.slice(a, 1024)
                keys, sizes = flat(some.column("keys"))
                nbytes, _ = flat(some.column("bytes"))
                rest = np.stack([some.column(c).to_numpy() for c in ("n", "first", "s1", "s2")], axis=1)
                held.append((keys, sizes, nbytes, rest))
                turns += len(nbytes) + len(rest)
                if turns >= limit:
                    yield nodes()
                    made, held, turns = made + 1, [], 0
        if held:
            yield nodes()
    return giving_back(run)


def turn_sequences(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: each conversation's turns as structs (turn, k1, k2, bytes) in order of ``turn``, null first.

    Null role or text is empty; rows of one conversation that share a turn come in a fixed order (by hash), repeated rows count as
    often as they come; rows without a conversation id are in no conversation.
    """
    r, t = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    one = F.struct(F.col(turn).cast("long").alias("turn"), F.xxhash64(F.lit(1), r, t).alias("k1"), F.xxhash64(F.lit(2), r, t).alias("k2"),
                   F.octet_length(t).cast("long").alias("bytes"))
    return (conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), one.alias("one"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns")))


def rebuilt(sequences: DataFrame, group: int = GROUP, shared: int = SHARED_TURNS) -> DataFrame:
    """Conversation c with the first h turns of conversation c - c % group (all if fewer, none if absent) and then its own after its
    first h; h is the crc32 of the decimal id modulo ``shared``."""
    own = sequences.withColumn("_base", F.col("conv_id") - F.col("conv_id") % group)
    given = (sequences.where(F.col("conv_id") % group == 0)
             .select(F.col("conv_id").alias("_base"), F.slice("turns", 1, shared - 1).alias("_given")))
    h = (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    head = F.coalesce(F.slice("_given", F.lit(1), h), F.slice("turns", 1, 0))
    tail = F.slice("turns", h + 1, F.size("turns"))
    return own.join(given, "_base", "left").select("conv_id", F.concat(head, tail).alias("turns"))


def _id_strings(batches):
    """Members sorted by (s1, s2, conv_id) to strings of comma-joined ids: ``s1, s2, at, ids``."""
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("at", pa.int64()), ("ids", pa.string())])
    key, ids, size = None, [], 0
    for batch in batches:
        out = []
        for s1, s2, c in zip(*[batch.column(k).to_pylist() for k in ("s1", "s2", "conv_id")]):
            if (s1, s2) != key or size > CHUNK:
                if ids:
                    out.append((*key, ids[0], ids))
                key, ids, size = (s1, s2), [], 0
            ids.append(c)
            size += 8
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*[(a, b, c, ",".join(map(str, x))) for a, b, c, x in out]))), schema=schema)
    if ids:
        yield pa.RecordBatch.from_pydict({"s1": [key[0]], "s2": [key[1]], "at": [ids[0]], "ids": [",".join(map(str, ids))]}, schema=schema)


def _id_hashes(batches):
    """Strings sorted by (s1, s2, at) to one digest a sequence: ``s1, s2, ends``."""
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("ends", pa.string())])
    key, h = None, None
    for batch in batches:
        out = []
        for s1, s2, ids in zip(*[batch.column(k).to_pylist() for k in ("s1", "s2", "ids")]):
            if (s1, s2) == key:
                h.update(b"," + ids.encode())
                continue
            if h is not None:
                out.append((*key, h.hexdigest()))
            key, h = (s1, s2), hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out))), schema=schema)
    if h is not None:
        yield pa.RecordBatch.from_pydict({"s1": [key[0]], "s2": [key[1]], "ends": [h.hexdigest()]}, schema=schema)


def _member_hashes(members: DataFrame) -> DataFrame:
    strings = members.repartitionByRange("s1", "s2", "conv_id").sortWithinPartitions("s1", "s2", "conv_id")
    strings = strings.mapInArrow(_id_strings, "s1 long, s2 long, at long, ids string")
    return (strings.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "at").select("s1", "s2", "ids")
            .mapInArrow(_id_hashes, "s1 long, s2 long, ends string"))


def _merged(shared: DataFrame) -> DataFrame:
    """Shared nodes (one row a run that has them) merged by prefix: final values, ``parent_first`` included."""
    node = ["id1", "id2"]
    whole = shared.groupBy(*node).agg(
        F.max("parent1").alias("parent1"), F.max("parent2").alias("parent2"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"),
        F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.max("s1").alias("s1"), F.max("s2").alias("s2"))
    whole = written(whole, "trie-shared")
    below = (whole.where("depth > 0").groupBy(F.col("parent1").alias("id1"), F.col("parent2").alias("id2"))
             .agg(F.count(F.lit(1)).alias("_below")))
    whole = (whole.join(below, node, "left").withColumn("children", F.col("children") + F.coalesce("_below", F.lit(0))).drop("_below")
             .withColumn("leaves", F.col("leaves") + F.when(F.col("children") == 0, 1).otherwise(0))
             .withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("bytes")))
    # a path: the shared nodes of a run's first or last sequence; each node is owned by one path
    sides = F.filter(F.array(F.when(F.col("on_first"), 0), F.when(F.col("on_last"), 1)), lambda x: x.isNotNull())
    paths = shared.select(*node, "batch", "depth", F.explode(sides).alias("side"))
    owners = paths.groupBy(*node).agg(F.min(F.struct("batch", "side")).alias("_o")).select(*node, "_o.batch", "_o.side", F.lit(True).alias("_own"))
    worth = owners.join(whole.select(*node, "leaves", "saved"), node)
    held = paths.join(worth, [*node, "batch", "side"], "left")
    up = Window.partitionBy("batch", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = (held.select(*node, *[F.sum(F.coalesce(c, F.lit(0))).over(up).alias(c) for c in ("leaves", "saved")])
            .groupBy(*node).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    parents = whole.select(F.col("id1").alias("parent1"), F.col("id2").alias("parent2"), F.col("first").alias("parent_first"))
    return (whole.drop("leaves", "saved").join(sums, node).join(parents, ["parent1", "parent2"], "left")
            .withColumn("parent_first", F.when(F.col("depth") > 0, F.col("parent_first"))))


def prefix_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row a distinct prefix of the ``sequences`` (``conv_id, turns`` as ``turn_sequences`` gives them):
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    The root (depth 0) is there where any conversation is, turnless ones included; no conversations give no rows. A conversation is a row of 24 bytes
    a turn in a task.
    """
    keys = F.flatten(F.transform("turns", lambda t: F.array(t["k1"], t["k2"])))
    rows = written(sequences.select("conv_id", keys.alias("keys"), F.transform("turns", lambda t: t["bytes"]).alias("bytes")), "trie-sequences")
    s1, s2 = F.xxhash64("keys").alias("s1"), F.xxhash64(F.lit(7), "keys").alias("s2")
    distinct = written(rows.groupBy("keys", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first")), "trie-distinct")
    dealt = distinct.repartitionByRange(F.slice("keys", 1, 2 * RANGE_TURNS)).sortWithinPartitions("keys").select("keys", "bytes", "n", "first", s1, s2)
    nodes = written(dealt.mapInArrow(_shards(shard_turns), NODES_DDL), "trie-nodes")
    shared = nodes.where("shared")
    merged = written(_merged(shared), "trie-merged")
    cols = ["first", "depth", "parent_first", "n", "children", "leaves", "saved", "s1", "s2"]
    finished = nodes.where("NOT shared")
    # a finished node below a shared one: its parent's smallest member is known after the merge, and joined run by run
    heads = shared.select("batch", F.col("id1").alias("parent1"), F.col("id2").alias("parent2")).join(
        merged.select(F.col("id1").alias("parent1"), F.col("id2").alias("parent2"), F.col("first").alias("_first")), ["parent1", "parent2"])
    hung = (finished.where("parent_first IS NULL").join(heads, ["batch", "parent1", "parent2"])
            .withColumn("parent_first", F.col("_first")))
    out = finished.where("parent_first IS NOT NULL").select(*cols).unionByName(hung.select(*cols)).unionByName(merged.select(*cols))
    ends = written(_member_hashes(rows.select("conv_id", s1, s2)), "trie-ends")
    named = out.where("s1 IS NOT NULL").join(ends, ["s1", "s2"]).unionByName(out.where("s1 IS NULL").withColumn("ends", F.lit(EMPTY)))
    return named.select(F.col("first").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                        F.col("ends").alias("ends_sha256"))


def op11_prefix_trie(spark, sf_dir) -> DataFrame:
    """Contract query: the prefix tree of the rebuilt conversations."""
    return prefix_nodes(rebuilt(turn_sequences(table(spark, sf_dir, "conversations"))))


OP11_SQL = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                        lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS t),
c AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''),
           lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM c, tab),
s AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:h::INT], a.turns[h::INT + 1:]) AS turns
  FROM hashed a LEFT JOIN c b ON b.conv_id = a.conv_id - a.conv_id % 5),
p AS (SELECT conv_id, d, turns[1:d::INT] AS prefix, len(turns) = d AS whole FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM s)),
n AS (
  SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE whole), '')) AS ends_sha256
  FROM p GROUP BY prefix, d),
k AS (SELECT prefix[1:d::INT - 1] AS prefix, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(n.prefix[n.d::INT].t)) END AS saved
  FROM n LEFT JOIN k ON n.prefix = k.prefix AND n.d = k.d),
up AS (SELECT prefix[1:u::INT] AS prefix, u AS d, saved, n_children FROM (SELECT *, unnest(range(d + 1)) AS u FROM m)),
t AS (SELECT prefix, d, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM up GROUP BY prefix, d)
SELECT m.conv_id, m.d AS depth, par.conv_id AS parent_conv_id, m.n_convs, m.n_children::BIGINT AS n_children, t.n_leaves,
       t.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN t ON m.prefix = t.prefix AND m.d = t.d
LEFT JOIN n par ON m.d > 0 AND par.d = m.d - 1 AND par.prefix = m.prefix[1:m.d::INT - 1]
"""
