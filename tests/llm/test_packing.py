import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.packing import Encoder, pack, shortest_pack_first

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts(seed, n=150):
    r = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "The", "Über", "don't", "we'LL", "''s", "123", "!!", "<|endoftext|>", "<|endof", "日本語", "é", "́", "🙂", "É", "İ", "ΑΣ ", "a" * 70, "\x85", "\x1c", " ", "½", "٣", "ǅ", "J̌"]
    return ["".join(r.choice(bits) if r.random() < 0.5 else chr(r.randrange(32, r.choice([0x250, 0x3000]))) for _ in range(r.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_ids_equal_the_library(seed):
    own, plain = Encoder(PATH), Tokenizer.from_file(PATH)
    assert own.local
    more = ["", "x" * 3000, "ab " * 4000, "Wort Über don't " * 500, " " * 500, "1" * 200 + "a" * 200 + "!" * 200] + [chr(c) + "a " + chr(c) for c in range(seed, 0x2F00, 4) if not 0xD800 <= c < 0xE000]
    for t in texts(seed) + more:
        ids = plain.encode(t, add_special_tokens=False).ids
        assert own.ids(t) == struct.pack(f"<{len(ids)}I", *ids), repr(t)


def test_long_texts_are_split_at_spaces(monkeypatch):
    import tidemark.llm.packing as p
    own, plain = Encoder(PATH), Tokenizer.from_file(PATH)
    monkeypatch.setattr(p, "CHUNK", 37)
    r = random.Random(1)
    for t in [" ".join("".join(r.choice("abC'stl1!\n") for _ in range(r.randrange(1, 12))) for _ in range(80)) for _ in range(40)] + ["y" * 400]:
        ids = plain.encode(t, add_special_tokens=False).ids
        assert own.ids(t) == struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("size", [64, 100])
def test_places_fill_every_sequence(size):
    r = random.Random(size)
    for case in range(60):
        histogram = {n: r.randrange(0, r.choice([2, 50, 1000])) for n in r.sample(range(1, size + 1), r.randrange(1, size))}
        if case == 0:
            histogram = {1: 100_000}
        places, n = shortest_pack_first(histogram, size)
        used, got = defaultdict(list), defaultdict(int)
        for length, rank, count, start, tokens, sequence, offset in places:
            for k in range(count):
                used[sequence + k].append((offset, tokens))
                got[length, rank + k] += tokens
        assert got == {(length, k): length for length, c in histogram.items() for k in range(c)}
        assert sorted(used) == list(range(n))
        for s, own in used.items():
            at = 0
            for offset, tokens in sorted(own):
                assert offset == at
                at += tokens
            assert at == size or (s >= n - size.bit_length() and at & (at - 1) == 0)


def test_longest_go_first_into_the_emptiest_pack():
    assert shortest_pack_first({5: 2, 3: 2}, 8)[0] == [(5, 0, 2, 0, 5, 0, 0), (3, 0, 2, 0, 3, 0, 5)]
    assert shortest_pack_first({4: 1, 3: 1, 2: 2, 1: 5}, 8)[0][:3] == [(4, 0, 1, 0, 4, 0, 0), (3, 0, 1, 0, 3, 1, 0), (2, 0, 1, 0, 2, 1, 3)]


LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("size,block_rows", [(16, 3), (64, 1000)])
def test_table(spark, size, block_rows):
    r = random.Random(size)
    data = [(i, " ".join(r.choice(["one", "two", "Drei", "überall", "x1"]) for _ in range(r.choice([0, 1, 3, 7, 20, 200])))) for i in range(120)]
    data += [(500, None), (501, ""), (502, "same text here"), (None, "null id"), (None, "null id"), (503, "wort " * 5000)] + [(600 + i, "same text here") for i in range(80)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in data], "doc_id long, text string, length string").repartition(5)
    got = pack(docs, PATH, size=size, block_rows=block_rows).withColumn("crc", F.crc32("ids")).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        if p.doc_id is not None:
            parts[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, t in data:
        if i is not None:
            ids, at = ids_of(t), 0
            for p in sorted(parts[i], key=lambda p: p.start):
                piece = struct.pack(f"<{p.length}I", *ids[at:at + p.length])
                assert (p.start, bytes(p.ids), p.crc, p.doc_tokens) == (at, piece, zlib.crc32(piece), len(ids))
                at += p.length
            assert at == len(ids)
    assert sum(p.length for p in got if p.doc_id is None) == 2 * len(ids_of("null id"))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at == size or at < size and at & (at - 1) == 0
    assert len([s for s, own in sequences.items() if sum(n for _, n in own) < size]) <= size.bit_length()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pack(docs, PATH).count() == 0
    assert pack(spark.createDataFrame([(1, None), (2, "")], docs.schema), PATH, end_id=None).count() == 0
    assert [tuple(r) for r in pack(spark.createDataFrame([("a", None)], "doc_id string, text string"), PATH).drop("ids").collect()] == [("a", 0, 1, 1, 0, 0)]
