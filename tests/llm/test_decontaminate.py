import random
import re

from tidemark.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[p:p + n]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w, hit, held = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if found := windows.get(tuple(w[p:p + n])):
                    hit |= set(range(p, p + n))
                    held |= found
        out.append((i, len(w), len(hit), sorted(held), bool(hit)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "a", "Né", "ß", "x1", "Zed", "ion", "to", "qu"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(r.choice([1, 2, 3, 4, 5, 9, 10, 11, 30]))) for k in range(4, 12)] + [(1, None), (2, ""), (3, "..."), (20, "the of a"), (21, "THE of, a")]
    items.append(items[0])
    docs = []
    for i in range(40):
        t = text(r.randrange(0, 60))
        if r.random() < 0.5:
            t += " - " + (r.choice(items)[1] or "") + "; " + text(5)
        docs.append((i, t))
    long = text(9) + " " + " ".join(f"w{k}" for k in range(20000)) + " " + items[3][1]
    return docs + [(100, None), (101, ""), (102, "!!"), (103, long)], items


def test_equals_brute_force(spark):
    for seed, block in ((1, 200_000), (2, 7)):
        docs, items = corpus(seed)
        d = spark.createDataFrame([(*x, "n", 1) for x in docs], "doc_id long, text string, words string, h long")
        b = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, n int")
        got = sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(d, b, block_rows=block).collect()], key=str)
        assert got == brute(docs, items)


def test_repeated_and_null_ids_and_empty_tables(spark):
    item = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, item), (1, item), (None, "x " + item), (None, None), (2, "one two")], "doc_id long, text string")
    b = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in contamination(d, b).collect()}
    assert got == {1: (11, 11, True), None: (12, 11, True), 2: (2, 0, False)}
    assert contamination(d.limit(0), b).count() == 0
    assert not any(r.contaminated for r in contamination(d, b.limit(0)).collect())
