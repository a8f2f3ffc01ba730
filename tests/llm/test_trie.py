"""Conversation tries against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cotopic.llm.prefixtrie import DoubleArray, prefix_nodes, rebuilt, turn_sequences

DDL = "conv_id long, turn long, role string, text string, depth int"


def plain(sequences: dict[int, list[tuple[str, str]]]):
    """The contract's rows from whole sequences."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        w = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += w
            leaves[p[:d]] += not kids[p]
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(p)).encode()).hexdigest())
                  for p, m in members.items())


def nodes(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def grouped(rows):
    turns = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            turns[c].append((t, r or "", x or ""))
    return {c: [x[1:] for x in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0))] for c, v in turns.items()}


def rows_of(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        hot = c % 3 == 0
        for t in range(rng.randrange(1, 7)):
            text = "hello" if hot and t < 2 else rng.choice(["a", "b", "é" * 3, "", None, f"own {c}"])
            rows.append((c, t if t else rng.choice([0, None]), rng.choice(["user", None]) if t > 2 else "user", text, 9))
    rows += [(1000 + k, t, "user", f"copy {t}", 1) for k in range(40) for t in range(5)]  # copies of one conversation
    rows += [(5000, t, "user", f"long {t % 7}", 1) for t in range(700)] + [(5001, t, "user", f"long {t % 7}", 1) for t in range(699)]
    rows += [(-7, 0, "user", "negative", 1), (None, 0, "user", "nobody", 1)]
    return rows


@pytest.mark.parametrize("shard_turns", [20, 400, 50_000])
def test_nodes_against_plain_prefixes(spark, shard_turns):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, DDL).repartition(3)
    assert nodes(prefix_nodes(turn_sequences(df), shard_turns)) == plain(grouped(rows))


def test_rebuilding(spark):
    rows = rows_of(4, 60)
    own = grouped(rows)

    def quotient(c):
        return c - (abs(c) % 5) * (1 if c >= 0 else -1)
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = own.get(quotient(c), [])[:h] + turns[h:]
    got = nodes(prefix_nodes(rebuilt(turn_sequences(spark.createDataFrame(rows, DDL)))))
    assert got == plain(want)
    assert any(not v for v in want.values())  # turnless conversations are members of the root


def test_repeated_rows_count_and_empty_tables(spark):
    rows = [(1, 0, "u", "x", 0), (1, 0, "u", "x", 0), (2, 0, "u", "x", 0)]
    df = spark.createDataFrame(rows, DDL)
    assert nodes(prefix_nodes(turn_sequences(df))) == plain({1: [("u", "x")] * 2, 2: [("u", "x")]})
    assert prefix_nodes(turn_sequences(df.limit(0))).count() == 0


def test_double_array_holds_exactly_its_sequences():
    rng = random.Random(5)
    for _ in range(20):
        seqs = sorted({tuple(rng.randrange(1, 40) for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(1, 200))})
        sizes = np.array([len(s) for s in seqs])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        trie = DoubleArray(np.array([x for s in seqs for x in s], np.int64), starts, sizes)
        known = {s[:d] for s in seqs for d in range(len(s) + 1)}
        assert (trie.check[:trie.top] != -1).sum() == len(known | {()})
        for _ in range(200):
            s = rng.choice(seqs)
            s = s[:rng.randrange(len(s) + 1)] + (rng.randrange(1, 45),)
            at = np.array([0])
            for x in s:
                at = trie.step(at, np.array([x]))
                if at[0] < 0:
                    break
            assert (at[0] >= 0) == (s in known)
