"""Token counts of whole texts with overlap resynchronisation.

A text longer than CHUNK is encoded in overlapping chunks with offsets. Byte-level BPE merges only inside the pieces that the
tokenizer's splitter makes, and the splitter reads a text from left to right: what follows a piece boundary doesn't depend on
what came before it. So a boundary is proven when it is a true one of the earlier chunk (whose pieces up to GUARD before its
end can't change with more text) and also a boundary of the later chunk; from there on the later chunk is right. Chunks are
spliced at such a boundary; where the overlap holds none, it is widened and the later chunk encoded again.

Pieces recur, so each task keeps their token counts. Splitting uses character classes probed from the tokenizer itself;
texts with characters beyond the probed range or with special strings go through the tokenizer's own encoder.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

CHUNK = 16_384
OVERLAP = 512
GUARD = 64
LIMIT = 1_024
PROBED = 0x2E80  # characters below are probed one by one
CACHED = 1_000_000  # pieces kept by a task
LONGEST = 64  # longer pieces are not kept


class Pieces(dict):
    """Token count by piece, filled on demand."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = n
        return n


def _ranges(chars: list[int]) -> str:
    out: list[list[int]] = []
    for c in chars:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


class Counter:
    """Token counts as the tokenizer file's own library gives them, without added tokens. For byte-level BPE without a normalizer
    texts are cut and spliced; any other tokenizer encodes whole texts."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        self.tokenizer, self.chunk, self.overlap = Tokenizer.from_file(path), chunk, overlap
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.counts = Pieces(self.tokenizer)
        split = self.tokenizer.pre_tokenizer
        self.local = type(split).__name__ == "ByteLevel" and self.tokenizer.normalizer is None and not split.add_prefix_space and split.use_regex
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.guard = max([GUARD, *(len(s) + 1 for s in specials)])
        if self.local:
            whole = lambda s: len(split.pre_tokenize_str(s)) == 1
            letters, digits, spaces = [], [], []
            for c in range(PROBED):
                kind = letters if whole("x" + chr(c)) else digits if whole("1" + chr(c)) else None if whole("!" + chr(c)) else spaces
                if kind is not None:
                    kind.append(c)
            a, n, s = _ranges(letters), _ranges(digits), _ranges(spaces)
            # the splitter of byte-level BPE files: contractions, letters, digits, other characters, spaces
            self.splitter = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{a}]+| ?[{n}]+| ?[^{s}{a}{n}]+|[{s}]+(?![^{s}])|[{s}]+")
            self.beyond = re.compile(f"[^\\u0000-\\u{PROBED - 1:04x}]")

    def plain(self, text: str) -> bool:
        return self.local and not self.beyond.search(text) and not (self.special and self.special.search(text))

    def pieces(self, text: str) -> tuple[list[int], list[int]]:
        """Start of each piece and tokens before it, each with one last entry for the end."""
        if self.plain(text):
            found = self.splitter.findall(text)
            return list(accumulate(map(len, found), initial=0)), list(accumulate(map(self.counts.__getitem__, found), initial=0))
        e = self.tokenizer.encode(text, add_special_tokens=False)
        starts, before, last = [], [], object()
        for i, (word, (start, _)) in enumerate(zip(e.word_ids, e.offsets)):
            if word is None or word != last:
                starts.append(start)
                before.append(i)
            last = word
        return [*starts, len(text)], [*before, len(e.ids)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) > self.chunk and self.local:
            return self.spliced(text)
        if self.plain(text):
            return sum(map(self.counts.__getitem__, self.splitter.findall(text)))
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def spliced(self, text: str) -> int:
        begin, end = 0, min(self.chunk, len(text))
        starts, before = self.pieces(text[:end])
        at, total = 0, 0  # a proven boundary, and the tokens before it
        while end < len(text):
            overlap, common = self.overlap, None
            while common is None:
                new_begin = max(at, end - overlap)
                new_end = min(len(text), end + max(self.chunk - self.overlap, overlap))
                new_starts, new_before = self.pieces(text[new_begin:new_end])
                proven = {begin + s for s in starts[bisect_left(starts, new_begin - begin):] if begin + s <= end - self.guard}
                common = at if new_begin == at else next((new_begin + s for s in new_starts if new_begin + s in proven), None)
                overlap *= 2
            total += before[bisect_left(starts, common - begin)] - before[bisect_left(starts, at - begin)]
            at, begin, end, starts, before = common, new_begin, new_end, new_starts, new_before
        return total + before[-1] - before[bisect_left(starts, at - begin)]


_COUNTERS: dict[tuple, Counter] = {}  # one for each Python worker


def counter(path: str, chunk: int, overlap: int) -> Counter:
    key = (path, chunk, overlap)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(*key)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit; columns of these names are replaced, others pass through.

    Null and empty texts: 0 and 0. Repeated rows are counted each. An empty table gives an empty one. `tokenizer` is the path
    of a tokenizer file that every executor has. No shuffle; a task holds one Arrow batch, one chunk's pieces and the kept counts.
    """
    if overlap >= chunk:
        raise ValueError("overlap must be smaller than chunk")

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(tokenizer, chunk, overlap)
        for texts in batches:
            yield pd.Series([own.count(t) for t in texts], dtype="int64")

    rest = docs.drop("n_bytes", "n_tokens", "over_limit")
    out = rest.withColumn("n_tokens", tokens("text"))
    return out.select("*", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")
