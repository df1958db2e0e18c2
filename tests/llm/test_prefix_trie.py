import hashlib
import random
import zlib
from collections import defaultdict

import pytest

import tidemark.llm.prefix_trie as trie
from tidemark.llm.prefix_trie import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + t[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        mine = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        kids = children[p]
        sums[p] = (sum(sums[k][0] for k in kids) or 1, mine + sum(sums[k][1] for k in kids))
        ids = ",".join(map(str, sorted(ends[p])))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), *sums[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows(seed, ids):
    r = random.Random(seed)
    out = []
    for c in ids:
        for turn in range(r.choice([0, 1, 3, 9, 14])):
            out.append((c, r.choice([turn, turn * 300 - 1000]), r.choice(["user", "bot"]), r.choice(["a", "b", "é", "", "lang " * 3])))
    out += out[:20]  # repeated rows
    return out + [(7, None, "user", "no number"), (7, None, None, None), (8, 3, "user", None), (None, 1, "user", "lost"), (11, 5, "x", "yz"), (16, 5, "xy", "z")]


@pytest.mark.parametrize("seed,ids", [(1, range(40)), (2, range(3, 90, 2)), (3, [-7, -5, -1, 0, 4, 2**62, 2**62 + 1, 2**62 + 3, 10**15])])
def test_equals_brute_force(spark, seed, ids, monkeypatch):
    monkeypatch.setattr(trie, "WIDTH", 4)
    monkeypatch.setattr(trie, "MEMBERS", 3)
    data = rows(seed, ids)
    random.Random(seed).shuffle(data)
    assert got(prefix_trie(frame(spark, data))) == brute(data)


def test_copies_and_a_long_conversation(spark):
    data = [(c, t, "user", f"turn {t}") for c in range(100, 400) for t in range(4)] + [(5, t, "bot", f"long {t % 7}") for t in range(3000)] + [(6, 0, "bot", "long 0")]
    assert got(prefix_trie(frame(spark, data))) == brute(data)


def test_colliding_fingerprints_are_seen(spark, monkeypatch):
    monkeypatch.setattr(trie, "PRIMES", (3, 2))
    monkeypatch.setattr(trie, "BASES", (2, 1))
    with pytest.raises(RuntimeError):
        prefix_trie(frame(spark, rows(1, range(30))))


def test_empty(spark):
    assert got(prefix_trie(frame(spark, []))) == []
    assert got(prefix_trie(frame(spark, [(None, 1, "a", "b")]))) == []
