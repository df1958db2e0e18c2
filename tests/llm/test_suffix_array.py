import random
from collections import defaultdict

from tidemark.llm.suffix_array import repeated_passages


def brute(rows, length):
    """Merged spans of words that lie in a window of `length` words also found in another document."""
    words = {i: (t or "").lower().split() for i, t in rows if i is not None}
    where = defaultdict(set)
    for i, w in words.items():
        for p in range(len(w) - length + 1):
            where[tuple(w[p:p + length])].add(i)
    out = set()
    for i, w in words.items():
        spans = []
        for p in range(len(w) - length + 1):
            if len(where[tuple(w[p:p + length])]) > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        out |= {(i, a, b) for a, b in spans}
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(5, 12)))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 55, 64, 80, 120, 400)]
    rows = []
    for i in range(60):
        w = text(r.randrange(0, 120))
        for p in r.sample(passages, r.randrange(0, 4)):
            w += p + text(r.randrange(0, 30))
        rows.append((i, " ".join(x.upper() if r.random() < 0.2 else x for x in w)))
    rows += [(100 + k, rows[7][1]) for k in range(5)]  # exact copies
    rows += [(200, " ".join(["le"] * 300)), (201, None), (202, ""), (203, " ".join(text(40))), (204, " \n ".join(text(3000))), (None, rows[8][1])]
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, pos int")
        got = repeated_passages(docs).collect()
        assert {(r.doc_id, r.start, r.stop) for r in got} == brute(rows, 50)
        assert all(r.n_words == r.stop - r.start >= 50 and r.other_id != r.doc_id and r.first == (r.doc_id < r.other_id) for r in got)


def test_long_runs_of_one_word_and_empty_tables(spark):
    rows = [(i, " ".join(["le"] * n)) for i, n in ((1, 300), (2, 70), (3, 49))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.start, r.stop) for r in repeated_passages(docs).collect()} == brute(rows, 50)
    assert repeated_passages(docs.limit(0)).count() == 0


def test_boilerplate_of_a_third_document_hides_no_passage(spark):
    r = random.Random(5)
    text = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(n)]
    rows, doc = [], 1000
    for n in (50, 52, 57, 64):
        for shared in (35, 40, 45, 49):
            for skip in range(0, n - shared + 1, 5):
                passage = text(n)
                rows += [(doc + k, " ".join(text(8) + passage + text(8))) for k in (1, 2)]
                # smaller and larger documents hold only a part of it
                rows += [(doc - 1000 if k else doc + 3, " ".join(text(9) + passage[skip:skip + shared] + text(9))) for k in (0, 1)]
                doc += 4
    docs = spark.createDataFrame([(i * 4 if i < 1000 else 10_000 + i, t) for i, t in rows], "doc_id long, text string")
    rows = [tuple(x) for x in docs.collect()]
    assert {(x.doc_id, x.start, x.stop) for x in repeated_passages(docs).collect()} == brute(rows, 50)


def test_one_copy_is_first_for_every_part_of_a_joined_passage(spark):
    r = random.Random(6)
    text = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(n)]
    head, body, long = text(60), text(70), text(200)
    rows = [(1, " ".join(head + text(5))), (100, " ".join(head + body + text(5))), (900, " ".join(text(7) + body))]
    # the smallest holder changes inside overlapping passages, back and forth
    rows += [(2000, " ".join(long[:80])), (2001, " ".join(long)), (2002, " ".join(long)), (1999, " ".join(text(3) + long[60:130]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in repeated_passages(docs).collect()}
    assert {(x.doc_id, x.start, x.stop) for x in got.values()} == brute(rows, 50)
    assert {i: x.first for i, x in got.items()} == {1: True, 100: True, 900: False, 1999: True, 2000: True, 2001: True, 2002: False}
    assert [tuple(x) for x in got[100].stretches] == [(0, 60, 1, False), (60, 130, 900, True)]
    assert [tuple(x) for x in got[900].stretches] == [(7, 77, 100, False)]
    rows += [(5000 + i, t) for i, t in corpus(3)[:-1]]
    cut, after, holders = {}, set(), defaultdict(set)
    for x in repeated_passages(spark.createDataFrame(rows, docs.schema)).collect():
        assert [s.start for s in x.stretches] == [x.start, *[s.stop for s in x.stretches][:-1]] and x.stretches[-1].stop == x.stop
        assert x.first == any(s.first for s in x.stretches) and all(s.first == (x.doc_id < s.other_id) for s in x.stretches)
        cut.setdefault(x.doc_id, []).extend((s.start, s.stop) for s in x.stretches if not s.first)
    for i, t in rows:
        w = (t or "").lower().split()
        smaller = {v for j, u in rows if j < i for v in (u or "").lower().split()}
        assert all(set(w[a:b]) <= smaller for a, b in cut.get(i, ()))
        left = [None if any(a <= p < b for a, b in cut.get(i, ())) else x for p, x in enumerate(w)]
        for p in range(len(w) - 49):
            holders[tuple(w[p:p + 50])].add(i)
            after.add(tuple(left[p:p + 50]))
    assert all(w in after for w, ids in holders.items() if len(ids) > 1)  # one whole copy of each is left
