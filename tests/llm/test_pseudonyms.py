import hashlib
import random
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.llm import pseudonyms
from tidemark.llm.pseudonyms import QUERY_KEY as KEY, ROUNDS, feistel


def pseudonymise(docs):
    return pseudonyms.pseudonymise(docs, KEY)


def plain_feistel(x, a, b, kind, tweak=0):
    left, right = divmod(x, b)
    for i in range(ROUNDS):
        mac = int(hashlib.sha256(f"{KEY}|{kind}|{tweak}|{i}|{right if i % 2 == 0 else left}".encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            left = (left + mac) % a
        else:
            right = (right + mac) % b
    return left * b + right


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_feistel_is_the_keyed_permutation(spark):
    got = spark.range(35 * 12).select("id", feistel(F.col("id"), 35, 12, KEY, "t").alias("y")).collect()
    assert sorted(r.y for r in got) == list(range(35 * 12))
    assert all(r.y == plain_feistel(r.id, 35, 12, "t") for r in got)


def test_values_keep_format_validity_and_links(spark):
    rows = [(1, "Call +1 (722) 555-6978 or pay 4387513035237269, 70.123.182.155."), (2, "4387513035237269"), (3, None), (4, ""),
            (5, "bad 4387513035237268 999.1.2.3 2020-02-30 666-12-1234 31.04.2021"), (6, "on 2020-02-29, 29.02.2020; 02/29/2020 and 2020/02/29 078-05-1120"),
            (7, "Write joe.smith1@mail.example.com or JOE.smith1@mail.example.com!"), (7, "x " * 40000 + "4387513035237269")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_values", F.lit("clash"))
    out = pseudonymise(docs)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    one = re.fullmatch(r"Call (\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}) or pay (4\d{15}), ((?:\d{1,3}\.){3}\d{1,3})\.", got[1][0].text)
    assert one and luhn(one[2]) and one[2] != "4387513035237269" and "555-6978" not in one[1] and one[3] != "70.123.182.155"
    assert got[2][0].text == one[2] and got[1][0].n_values == 3
    assert (got[3][0].text, got[3][0].n_values, got[4][0].text) == (None, 0, "")
    assert got[5][0].text == rows[4][1] and got[5][0].n_values == 0 and got[5][0].n_invalid == 5
    new = date(1900, 1, 1) + timedelta(plain_feistel((date(2020, 2, 29) - date(1900, 1, 1)).days, 229, 319, "date"))
    assert got[6][0].text.startswith(f"on {new:%Y-%m-%d}, {new:%d.%m.%Y}; {new:%m/%d/%Y} and {new:%Y/%m/%d} ") and got[6][0].n_values == 5
    mail = re.fullmatch(r"Write (\S+)@mail.example.com or (\S+)@mail.example.com!", got[7][0].text if "Write" in got[7][0].text else got[7][1].text)
    assert mail[1] == mail[2] and re.fullmatch(r"[a-z0-9]{3}\.[a-z0-9]{6}", mail[1]) and mail[1] != "joe.smith1"
    assert any(r.text == "x " * 40000 + one[2] for r in got[7])
    assert out.limit(0).count() == 0 and pseudonymise(docs.limit(0)).columns == out.columns


def test_no_phone_is_left_behind(spark):
    form = re.compile(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}")
    phones = [f"+1 ({a:03}) {m:03}-{n:04}" for a in (0, 17, 100, 199, 200, 555, 999) for m in (0, 99, 199, 200, 713, 999) for n in (0, 7713, 9999)]
    docs = spark.createDataFrame([(i, f"call {p}, or {phones[-1 - i]}") for i, p in enumerate(phones)], "doc_id long, text string")
    out = sorted(pseudonymise(docs).collect())
    new = {p: form.findall(r.text)[0] for p, r in zip(phones, out)}
    assert sum(p in r.text for p, r in zip(phones, out)) == 0 and all(r.n_values == 2 and r.n_invalid == 0 for r in out)
    assert all(form.findall(r.text)[1] == new[phones[-1 - i]] for i, r in enumerate(out)) and len(set(new.values())) == len(phones)
    usual = re.compile(r"\+1 \([2-9][0-9]{2}\) [2-9]")  # area code and exchange of 200 or more, or not
    assert all(bool(usual.match(p)) == bool(usual.match(q)) for p, q in new.items())
    area, mid, line = 17, 555, 7713
    top, last = divmod(plain_feistel((area * 1000 + mid) * 10_000 + line, 60_000, 60_000, "phone", 1), 10_000)
    area, mid = divmod(top, 1000) if top < 200_000 else (200 + (top - 200_000) // 200, (top - 200_000) % 200)
    text = pseudonymise(spark.createDataFrame([(1, "+1 (017) 555-7713")], "doc_id long, text string")).first().text
    assert text == f"+1 ({area:03}) {mid:03}-{last:04}"


def test_values_without_two_neighbouring_digits_are_found(spark):
    rows = [(1, "8.8.8.8"), (2, "from 1.1.1.1 on"), (3, "8.8.8.8, 1.1.1.1 and 2020-02-29"), (4, "version 1.2 of 3")]
    got = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first, second = got[1].text, got[2].text.split()[1]
    assert got[3].text.startswith(f"{first}, {second} and ") and first != "8.8.8.8" and second != "1.1.1.1"
    assert [got[i].n_values for i in (1, 2, 3, 4)] == [1, 1, 3, 0] and got[4].text == rows[3][1]


def test_long_texts_are_searched_in_linear_time(spark):
    labels = "x@" + "a." * 100_000 + "com"
    rows = [(1, labels), (2, labels + " 8.8.8.8"), (3, "7" * 1_000_000), (4, "q" * 1_000_000), (5, "a@" * 500_000), (6, "a." * 500_000 + "@b"), (7, "x@" + "a." * 120 + "com"), (8, "+1 (" * 200_000)]
    got = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_values for i in range(1, 9)] == [0, 1, 0, 0, 0, 0, 1, 0]
    assert all(got[i].text == rows[i - 1][1] for i in (1, 3, 4, 5, 6, 8)) and got[7].text.endswith(rows[6][1][1:]) and got[7].text[0] != "x@"


def test_addresses_are_found_as_by_the_plain_pattern(spark):
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "b.", ".", "@", "@c", ".com", ".de", "-", " ", "_", "x1", ".."]) for _ in range(r.randrange(2, 25))) for _ in range(600)]
    got = {x.doc_id: x.n_values for x in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(600)] == [len(plain.findall(t)) for t in texts]
