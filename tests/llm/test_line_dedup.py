import random
from collections import defaultdict

from tidemark.llm.line_dedup import LineRuns, dedup_lines, id_batches

BLANK = " \t\n\x0b\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_chars, min_docs):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows(seed):
    r = random.Random(seed)
    pool = ["short", "a line of text that is long enough", "  A Line of text THAT is long enough\t", "ÀÉ " * 8, "éÀ" * 8, "", " ", "\r", "x" * 5000, "tie " * 6, "İstanbul " * 4]
    out = [(r.randrange(25), "\n".join(r.choice(pool) for _ in range(r.randrange(0, 9)))) for _ in range(60)]
    return out + [(7, None), (8, ""), (None, pool[1] + "\n" + pool[9]), (30, "\n".join(f"line number {k} of a very long text" for k in range(3000))), (31, "line number 5 of a very long text")] + out[:3]


def test_equals_brute_force(spark):
    for batches in (1, 4, 9):
        data = rows(batches)
        docs = spark.createDataFrame([(i, t, "clash", i) for i, t in data], "doc_id long, text string, n_dropped string, holder long")
        got = sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(docs, 20, 3, batches).collect()], key=str)
        assert got == brute(data, 20, 3)


def test_runs_are_compacted_and_count_once(spark):
    runs = LineRuns(spark, fan_out=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(1, 1, 100 - b), (b, 2, 100 - b), (1, 1, 100 - b)], "h1 long, h2 long, doc_id long"))
    got = {(r.h1, r.h2): (r.n_docs, r.holder) for r in runs.merged().collect()}
    assert got[1, 1] == (5, 100) and got[3, 2] == (1, 97) and len(runs.runs()) <= 3


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert dedup_lines(docs).columns == ["doc_id", "text", "lang", "n_lines", "n_dropped"] and dedup_lines(docs).count() == 0


def test_ids_over_the_whole_range_and_one_far_away(spark):
    line = "a line of text that is long enough"
    for ids in ([-9_200_000_000_000_000_000 + k * 2_300_000_000_000_000_000 for k in range(9)], [*range(40), 9_000_000_000_000_000_000]):
        data = [(i, f"{line}\n{i}") for i in ids] + [(None, line)]
        docs = spark.createDataFrame(data, "doc_id long, text string")
        got = sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(docs, 20, 3, 4).collect()], key=str)
        assert got == brute(data, 20, 3)
        sizes = docs.where("doc_id is not null").groupBy(id_batches(docs, 4).alias("b")).count().collect()
        assert max(r["count"] for r in sizes) <= len(ids) // 2
