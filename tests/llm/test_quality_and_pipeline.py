import random

import numpy as np

import corpus_pipeline
from tidemark.llm.common import staged
from tidemark.llm.ordinal_quality import features, fit, graded, rate, slot, train


def labelled(n, seed):
    r = random.Random(seed)
    good, bad, foul = [f"good{k}" for k in range(300)], ["&&&", "%%%", "!!"], ["vile", "nasty", "rotten"]
    rows = []
    for i in range(n):
        grade = r.choice([0, 1, 2, 2, 2])
        w = [r.choice(good) for _ in range(r.randrange(5, 120))]
        if grade == 1:
            w = [x + r.choice(bad) for x in w]
        if grade == 0:
            w.insert(r.randrange(len(w)), r.choice(foul))
        rows.append((i, " ".join(w), grade))
    return rows


def test_held_out_accuracy_and_ordered_thresholds(spark):
    rows = labelled(3000, 1)
    vectors = [np.unique(np.array([slot(f) for f in features(t)])) for _, t, _ in rows]
    grades = np.array([g for *_, g in rows])
    model = fit(vectors[:2000], grades[:2000])
    assert (np.diff(model.thresholds) > 0).all()
    known = dict(zip(model.slots.tolist(), model.weights.tolist()))
    tails = model.tails(np.array([sum(known.get(int(s), 0) for s in v) for v in vectors[2000:]]))
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails[:, 1] >= 0.5) == (grades[2000:] == 2)).mean() > 0.97
    again = fit(vectors[:2000], grades[:2000])
    assert np.array_equal(again.weights, model.weights)


def test_gradient_is_that_of_the_likelihood():
    rows = [np.array([k % 3, 5 + k % 2]) for k in range(12)] * 3
    grades = np.array([(k % 3) for k in range(12)] * 3)
    loose, firm = fit(rows, grades, 3000, 0.05, 0.0), fit(rows, grades, 300, 0.05, 0.0)

    def loss(m):
        known = dict(zip(m.slots.tolist(), m.weights.tolist()))
        t = m.tails(np.array([sum(known.get(int(s), 0) for s in r) for r in rows]))
        p = np.column_stack([1 - t[:, 0], t[:, 0] - t[:, 1], t[:, 1]])
        return -np.log(np.maximum(p[np.arange(len(p)), grades], 1e-12)).mean()

    assert loss(loose) < loss(firm) < 0.5


def test_tables(spark):
    rows = labelled(600, 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (9002, " ".join(f"good{k * k % 300}" for k in range(30000)), "x"), (None, "vile", "x"), rows[0][:2] + ("x",)], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(g != 1), int(g == 0), t) for i, t, g in rows] + [(1, None, 0, ""), (None, 1, 0, ""), (5, 1, 1, "")], "doc_id long, quality int, toxic int, text string")
    assert graded(labels).where("doc_id = 5").first().grade == 0
    model = train(docs, graded(labels), 400)
    out = rate(docs, model).collect()
    assert len(out) == len(rows) + 5 and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in out)
    assert {r.doc_id for r in out if r.kept} >= {9002}
    assert train(docs, graded(labels.limit(0))) is None and all(r.kept for r in rate(docs, None).collect())
    assert rate(docs.limit(0), model).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rows = labelled(400, 3)
    line = "this notice stands in a great many documents of the corpus\n"
    item = "which of the nine planets named here was found last of all by far"
    docs = [(i, line + t if i % 4 == 0 else t, "en", f"src{i % 5}", len(t), "extra") for i, t, _ in rows]
    clean = " ".join(sorted(max((t for _, t, g in rows if g == 2), key=len).split()))
    docs += [(1000, clean, "en", "src1", 1, "e"), (1001, clean, "en", "src1", 1, "e"), (1002, " ".join(reversed(clean.split())) + " " + item, "de", "src2", 1, "e"), (1003, None, None, None, None, None), (1004, "", "en", "src1", 0, "e")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    sf = str(tmp_path)
    spark.createDataFrame(docs, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, int(g != 1), int(g == 0)) for i, _, g in rows], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = now.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in now.select("doc_id").collect()}
        now = staged(stage(spark, now, sf), name)
        ids = {r.doc_id for r in now.select("doc_id").collect()}
        assert ids <= before
        seen.append((name, ids, {r.doc_id: r for r in now.collect()}))
        assert now.columns[:len(columns)] == columns
    by = {name: (ids, at) for name, ids, at in seen}
    wrong = sum((i in by["quality"][0]) != (g == 2) for i, _, g in rows)
    assert wrong <= 12
    noted = [i for i in by["lines"][0] if i is not None and i < 400 and i % 4 == 0]
    assert [i for i in noted if line.strip() in by["lines"][1][i].text] == [max(noted)]
    assert by["lines"][0] == by["quality"][0] and by["lines"][1][1000].kept == "e"
    assert 1000 in by["near"][0] and 1001 not in by["near"][0]
    assert 1002 in by["near"][0] and 1002 not in by["decontaminated"][0]
    assert by["mixed"][0] and now.columns == [*columns, "domain", "n_tokens", "epoch"]
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, ran.collect())) == sorted(map(str, now.collect()))
    empty = now.select(*columns).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_labels_of_absent_documents_use_up_no_sample(spark):
    rows = labelled(60, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    grades = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    absent = spark.range(1000, 20_000).selectExpr("id AS doc_id", "2 AS grade")
    one, two = train(docs, grades, 100), train(docs, grades.union(absent), 100)
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.slots, two.slots)


def test_null_ids_and_repeated_rows_pass_the_stages(spark, tmp_path):
    r = random.Random(9)
    words = [f"w{k}" for k in range(4000)]
    text = [" ".join(r.choice(words) for _ in range(80)) for _ in range(6)]
    item = " ".join(text[4].split()[20:40])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, text[0]), (None, text[0]), (2, text[1]), (2, text[1]), (None, text[2]), (None, text[2]), (3, text[3]), (None, text[4]), (None, text[5]), (4, text[4]), (None, None)]
    docs = spark.createDataFrame([(*x, "en") for x in rows], "doc_id long, text string, lang string")
    near = staged(corpus_pipeline.near(spark, docs, str(tmp_path)), "t")
    assert near.columns == docs.columns
    assert sorted(x.text or "" for x in near.collect()) == sorted(["", *text])
    clean = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert sorted([(x.doc_id, x.text) for x in clean.collect()], key=str) == sorted([x for x in rows if x[1] != text[4]], key=str) and clean.columns == docs.columns
