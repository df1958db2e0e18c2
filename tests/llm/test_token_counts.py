import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.token_counts import Counter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts(seed, n=60):
    r = random.Random(seed)
    bits = [" ", "  ", "\n", "\t ", "the", "Über", "don't", "we'll", "123", "!!", "<|endoftext|>", "<|endof", "日本語", "́", "🙂", "é", "a" * 70, " " * 30, "\x85"]
    return ["".join(r.choice(bits) if r.random() < 0.7 else chr(r.randrange(32, 0x3000)) for _ in range(r.randrange(1, 300))) for _ in range(n)]


@pytest.mark.parametrize("chunk,overlap", [(96, 8), (200, 80), (1000, 100), (16384, 512)])
def test_spliced_counts_equal_the_library(chunk, overlap):
    own, plain = Counter(PATH, chunk, overlap), Tokenizer.from_file(PATH)
    for t in texts(chunk) + ["", "x" * 5000, " " * 3000, "ab " * 4000, "<|endoftext|>" * 300, "日" * 900, "1" * 700 + "a" * 700 + " !" * 500]:
        assert own.count(t) == len(plain.encode(t, add_special_tokens=False).ids)


def test_overlap_is_widened_over_one_long_piece():
    own = Counter(PATH, 256, 16)
    t = "word " * 40 + "q" * 20000 + " word" * 100
    assert own.count(t) == len(Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, plain = Counter(path, 64, 8), Tokenizer.from_file(path)
    for t in texts(5, 20):
        assert own.count(t) == len(plain.encode(t, add_special_tokens=False).ids)


def test_table(spark):
    rows = [(1, None, 7), (2, "", 8), (3, "Hello  world", 9), (3, "Hello  world", 9), (None, "é" * 2000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, PATH).collect()))
    n = len(Tokenizer.from_file(PATH).encode("é" * 2000, add_special_tokens=False).ids)
    assert got == [(0, 4000, n, n > 1024), (1, 0, 0, False), (2, 0, 0, False), (3, 12, 3, False), (3, 12, 3, False)]
    assert count_tokens(docs.limit(0), PATH).count() == 0
