import pathlib
import random
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import superminhash as m
from tidemark.llm.components import components
from tidemark.llm.embedding_groups import group_vectors, portions


def closed(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(150)] + [(5000, 5001 + k) for k in range(400)] + [(7, 7)]
    df = spark.createDataFrame(links + [(None, 3), (4, None)], "a long, b long")
    want = closed({x for e in links if e[0] != e[1] for x in e}, links)
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def shingles(t, size):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\f", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh é") for _ in range(r.randrange(1, 6)))
    rows, i = [], 0
    for _ in range(25):
        base = [word() for _ in range(r.choice([1, 3, 5, 20, 60, 150]))]
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = word()
            rows.append((i, r.choice([" ", "\n", "\t "]).join(x.upper() if r.random() < 0.1 else x for x in w)))
            i += 1
    chain = [f"c{k}" for k in range(80)]
    for k in range(30):  # each near the next, the ends far apart
        rows.append((i + k, " ".join([f"n{x}" for x in range(k)] + chain[k:])))
    return rows + [(900, None), (901, ""), (902, " \n\t"), (903, " ".join(chain * 200)), (904, rows[3][1]), (905, "\xa0 x")]


@pytest.mark.parametrize("size,block", [(4, 512), (5, 4)])
def test_near_duplicates_equal_brute_force(spark, size, block):
    rows = corpus(size)
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, n int, rep int")
    sets = {i: shingles(t, size) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closed(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(docs, size, 80, block).collect()}
    assert got == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_rows_without_ids_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0, r.component_id, r.kept) for r in m.near_duplicates(docs).collect()), key=str) == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert m.near_duplicates(docs.limit(0)).count() == 0


def test_signature_estimates_similarity_with_low_variance():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        a, b, c = (r.integers(0, 2**63, k, dtype="int64").astype("uint64") for k in (400, 50, 50))
        x, y = m.signature(np.concatenate([a, b])), m.signature(np.concatenate([a, c]))
        errors.append((x == y).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 1.15 * (0.16 / m.SIGNATURE) ** 0.5


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(5)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            base = r.normal(size=16)
            for _ in range(int(r.integers(1, 8))):
                rows.append((i, [float(np.float32(x)) for x in base + r.normal(size=16) * r.choice([0, 0.02, 0.05, 0.1, 0.15])], label))
                i += 1
    rows += [(800, rows[0][1], 0), (801, [-x for x in rows[0][1]], 0), (802, [2 * x for x in rows[0][1]], 0), (803, [0.0] * 16, 0), (804, None, 0), (805, [], 1),
             (806, [1.0, None] * 8, 1), (807, [float("nan")] * 16, 1), (808, [float("inf")] * 16, 1), (809, [1.0, 2.0], 0), (810, [1.0, 2.0], 0)]
    ok = {a: np.array(v, dtype=float) for a, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {a: y for a, _, y in rows}
    links = [(a, b) for a, b in combinations(ok, 2) if label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.98]
    want = closed([x[0] for x in rows], links)
    data = spark.createDataFrame([(*x, 3) for x in rows], "vec_id long, embedding array<double>, label int, cell int").withColumn("embedding", F.col("embedding").cast("array<float>"))
    for cells, block in ((1024, 1024), (5, 3)):
        got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in group_vectors(data, per_cell=cells, block=block).collect()}
        assert got == {a: (sum(a in e for e in links), want[a], want[a] == a) for a, _, _ in rows}
    assert group_vectors(data.limit(0)).count() == 0


def test_embeddings_held_in_portions_are_stored_once(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(40, 12))
    rows = [(i, [float(x) for x in base[i % 40] + r.choice([0.02, 0.06, 0.3]) * r.normal(size=12)], i % 3) for i in range(900)]
    v = np.array([x[1] for x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([x[2] for x in rows])
    linked = (v @ v.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(rows), dtype=bool)
    want = closed(range(len(rows)), list(zip(*np.nonzero(linked))))
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.glob("**/*.parquet"))
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in group_vectors(data, per_cell=30, block=50, held=400).collect()}
    assert got == {i: (int(linked[i].sum()), want[i], want[i] == i) for i in range(len(rows))}
    # however many cells a vector visits, it is written once
    files = [pq.ParquetFile(f) for f in set(folder.glob("**/*.parquet")) - before]
    assert sum(f.metadata.num_rows for f in files if "vec" in f.schema_arrow.names) == len(rows)


def test_portions_hold_whole_slots_and_cut_large_ones():
    assert portions({5: 4, 1: 3, 2: 3, 9: 21, 10: 2}, 10) == [(1, 6, 0, 1), (9, 10, 0, 3), (9, 10, 1, 3), (9, 10, 2, 3), (10, 11, 0, 1)]
    assert portions({}, 10) == []
