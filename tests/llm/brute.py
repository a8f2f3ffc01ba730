"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
from collections import defaultdict


def repeats(rows, window):
    """{row index: (n_bytes, n_removed, n_spans, kept sha256)} for a list of texts."""
    data = [(t or "").encode() for t in rows]
    seen = defaultdict(int)
    for d in data:
        for i in range(len(d) - window + 1):
            seen[d[i:i + window]] += 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - window + 1):
            if seen[d[i:i + window]] > 1:
                gone[i:i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text, n=3, seed=42):
    import re

    import xxhash
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    sh = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def link_components(ids, fps, bits=3):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [least[find(i)] for i in range(len(ids))]


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def lines(rows):
    """Rows (id, text, ...) with the lines that stay, and how many each had and lost."""
    owner = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            k = line_key(x)
            if i is not None and len(k) >= 10:
                owner[k] = min(i, owner.get(k, i))
    out = []
    for i, t, *more in rows:
        parts = (t or "").split("\n")
        stay = [x for x in parts if i is None or len(line_key(x)) < 10 or owner[line_key(x)] == i]
        out.append(((i, t if t is None else "\n".join(stay), *more), len(parts), len(parts) - len(stay)))
    return out


def one_of_each(rows, bits=3):
    """Rows (id, text, ...) of which each class of near copies keeps one document."""
    import xxhash
    fps = [simhash(t) for _, t, *_ in rows]
    classes = defaultdict(list)
    for r, c in zip(rows, link_components(list(range(len(rows))), fps, bits)):
        h = xxhash.xxh64_intdigest(r[1].encode(), 42)
        classes[c].append((r[0] is None, r[0] or 0, h - (h >> 63 << 64), r))
    return [x[3] for c in classes.values() for x in c if x[:3] == min(y[:3] for y in c)]


def mixed(rows, limit, seed=7):
    """Rows (id, text, source) as often as tempered weights have them, by plain sums in hash order."""
    import math
    size = lambda r: len((r[1] or "").split())
    tokens = defaultdict(int)
    for r in rows:
        tokens[r[2]] += size(r)
    spread = max(tokens.values()) / min(tokens.values())
    a = 0.0 if spread <= limit else min(1.0, math.ceil((1 - math.log(limit) / math.log(spread)) * 1e6) / 1e6)
    power = {s: (t / sum(tokens.values())) ** a for s, t in tokens.items()}
    weight = {s: p / sum(power.values()) for s, p in power.items()}
    total = max(tokens[s] / weight[s] for s in tokens)
    out = []
    for s, t in tokens.items():
        passes, rest = divmod(max(t, math.floor(weight[s] * total + 0.5)), t)
        mine = [r for r in rows if r[2] == s]
        out += mine * passes
        before = 0
        for r in sorted(mine, key=lambda r: hashlib.md5(f"{seed}|{passes}|{r[0]}".encode()).hexdigest()):
            if before < rest:
                out.append(r)
            before += size(r)
    return out


def cut_pieces(rows, encode, capacity=1024, end=2):
    """(id, piece, start, length, crc32) of every row (id, text, ...)."""
    import zlib
    out = []
    for i, t, *_ in rows:
        ids = [*encode(t or ""), end]
        cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            out.append((i, p, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    return out
