import random

from pyspark.sql import functions as F

from tidemark.llm.mixing import mix, token_count
from tidemark.llm.url_rules import judge_urls


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(h.count("."), len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_urls_equal_every_rule_tried(spark):
    r = random.Random(4)
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/es/x", "allow"), ("a.example.org", "", "block"), ("com", "/fr/", "block"), ("b-c.com", "/", "allow"), ("c.com", "/q", "block")]
    hosts = ["example.org", "A.Example.ORG", "x.a.example.org", "aexample.org", "org", "b-c.com", "c.com", "x.c.com", "net", "", "a..org", "ü.com", "x.org:80"]
    urls = [f"{r.choice(['http', 'x'])}://{r.choice(hosts)}{r.choice(['', '/', '/es/', '/es/xy', '/fr/1', '/q', '/ES/'])}{r.choice(['', '?a=/es/', '#://', '/' * 5000])}" for _ in range(400)]
    urls += [None, "", "org/es/", "://", "a://b://example.org/es/", "\n://org/\nes"]
    pages = spark.createDataFrame([(i, u, "k", i) for i, u in enumerate(urls)] + [(0, urls[0], "k", 1)], "page_id long, url string, key string, depth int")
    table = spark.createDataFrame([(*x, 1) for x in rules] + [(None, "/", "block", 1), ("org", "/", "allow", 2)], "host string, path string, verdict string, rule int")
    for block in (100_000, 2):
        got = judge_urls(pages, table, block_rows=block).collect()
        assert len(got) == len(urls) + 1
        assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got} == {i: plain(u, rules) for i, u in enumerate(urls)}
    assert judge_urls(pages.limit(0), table).count() == 0
    assert {x.verdict for x in judge_urls(pages, table.limit(0), default="block").collect()} == {"block"}


def documents(spark):
    r = random.Random(8)
    rows = []
    for i in range(900):
        source = r.choice(["src0"] * 9 + ["src1", "src2", "src5", "src7", None, "other"])
        rows.append((i, " ".join("w" for _ in range(r.randrange(1, 60))), r.choice(["en", "en", "de", None]), source, "clash"))
    rows += [(2000, None, "en", "src0", "c"), (2001, "", "en", "src0", "c"), (2002, " \n", "en", "src0", "c"), rows[0], (None, "a b", "en", "src0", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch string")


def test_mixture_follows_weights_and_capacities(spark):
    weights = {"domain": {"web": 50, "news": 30, "books": 15, "forum": 5}, "lang": {"en": 70, "de": 30}}
    docs = documents(spark)
    for percent, epochs, buckets in ((40, 4, 4096), (90, 2, 4), (400, 3, 16)):
        got = mix(docs, weights, percent, epochs, "s", buckets).toPandas()
        assert list(got.columns) == ["doc_id", "text", "lang", "source", "domain", "n_tokens", "epoch"]
        have = docs.withColumn("n", token_count(F.col("text"))).toPandas()
        total, longest = have["n"].sum(), have["n"].max()
        target = min(total * percent // 100, total * epochs)
        leaves = got.fillna("").groupby(["lang", "source"]).ngroups
        assert target - leaves - 40 <= got["n_tokens"].sum() <= target + leaves * longest
        assert got["epoch"].max() < epochs and not set(got["doc_id"].dropna()) & {2000, 2001, 2002}
        for _, leaf in got.fillna("").groupby(["lang", "source"]):  # whole epochs, then one prefix
            sizes = leaf.groupby("epoch").size()
            assert list(sizes.index) == list(range(len(sizes))) and len(set(sizes.iloc[:-1])) <= 1
    again = mix(docs, weights, 40, 4, "s").toPandas()
    assert sorted(map(str, again.itertuples(index=False))) == sorted(map(str, mix(docs, weights, 40, 4, "s", 64).toPandas().itertuples(index=False)))
    assert mix(docs.limit(0), weights).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    rows = [(i, "t " * 10, "en", "src0") for i in range(100)] + [(200 + i, "t " * 10, "de", "src0") for i in range(2)] + [(300 + i, "t " * 10, "en", "src1") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix(docs, {"domain": {"web": 1, "news": 1}, "lang": {"en": 1, "de": 1}}, 50, 1).groupBy("domain", "lang").agg(F.sum("n_tokens").alias("n")).collect()
    assert {(r.domain, r.lang): r.n for r in got} == {("web", "de"): 20, ("web", "en"): 490, ("news", "en"): 510}
