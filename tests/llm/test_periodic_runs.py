import hashlib
import random
import zlib

import pytest

from tidemark.llm.periodic_runs import digest, periodic_runs, runs_of, with_repeats


def brute(words, min_words=24):
    """Every maximal stretch by comparing words q apart, for every q; a stretch keeps its smallest period."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_words, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted([(a, b - a, q) for (a, b), q in found.items()], key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def strings(seed):
    r = random.Random(seed)
    yield [r.choice("ab") for _ in range(r.randrange(400))]
    block = [str(r.randrange(1000)) for _ in range(r.randrange(1, 90))]
    yield [str(r.randrange(9)) for _ in range(20)] + block * r.randrange(3, 9) + [str(r.randrange(9)) for _ in range(20)]
    noisy = block * 9
    noisy[r.randrange(len(noisy))] = "x"
    yield noisy
    nested = (["a"] * r.randrange(1, 30) + ["b"] + ["c", "d"] * r.randrange(1, 20)) * 4
    yield nested + nested[:r.randrange(len(nested))]
    inner = [r.choice("abc") for _ in range(r.randrange(2, 7))] * r.randrange(3, 9)
    outer = (inner + [str(r.randrange(50)) for _ in range(r.randrange(0, 12))]) * 5
    yield outer + outer[:7] + (inner * 2 + ["z"]) * 4


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    words = [[w.encode() for w in s] for s in strings(seed)]
    for min_words in (24, 1, 100):
        assert runs_of(words, min_words) == [brute(w, min_words) for w in words]


def test_structured_words():
    morse = "".join(str(bin(i).count("1") % 2) for i in range(1500))
    cases = [fibonacci(1200), morse, morse[:200] * 4, fibonacci(400) * 3, "a" * 700, "ab" * 300, ("a" * 40 + "b") * 20, "abc" * 8, "abc" * 7 + "ab"]
    words = [[c.encode() for c in s] for s in cases]
    assert runs_of(words) == [brute(w) for w in words]


def rows():
    r = random.Random(3)
    return [(1, None, 5), (2, "", 6), (3, " \t\n\x0b\f\r", 7), (4, "a b " * 20, 8), (4, "a b " * 20, 8), (None, "x y　z " * 12, 9), (5, "Wort\x1c " * 30 + "ende", None),
            (6, " ".join(str(r.randrange(10**6)) for _ in range(30000)), 1), (7, (" ".join(str(r.randrange(10**6)) for _ in range(7001)) + "\n") * 4, 1)]


def test_table(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, runs int")
    got = sorted([(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs, at_once=50).collect()], key=str)
    want = []
    for i, text, _ in rows():
        words = [w.decode() for w in (text or "").encode().split()]
        runs = brute(words) if len(words) < 5000 else [(0, 28004, 7001)] if i == 7 else []
        want.append((i, runs, kept(words, runs)))
    assert got == sorted(want, key=str)
    assert periodic_runs(docs.limit(0)).columns == ["doc_id", "text", "runs", "collapsed"] and periodic_runs(docs.limit(0)).count() == 0


def test_query_columns(spark):
    r = random.Random(4)
    data = [(i, " ".join(r.choice(["ja", "nein", "und"] + [str(k) for k in range(r.choice([1, 400]))]) for _ in range(r.choice([0, 1, 5, 60, 300])))) for i in range(150)] + [(900, None), (None, "a " * 40)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {x.doc_id: tuple(x)[1:] for x in digest(periodic_runs(with_repeats(docs))).collect()}
    planted = 0
    for i, text in data:
        words = (text or "").split()
        h, n = (zlib.crc32(str(i).encode()), len(words)) if i is not None else (1, 0)
        if h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute(words)
        best = max(runs, key=lambda x: (x[1] * 10**6 // x[2], -x[0], -x[2])) if runs else None
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(kept(words, runs)))
        assert got[i] == want
    assert planted > 5
