"""Packing documents into sequences of a fixed size: shortest-pack-first over the histogram of lengths.

1. Encode every text, append the end id, and write the ids once to the shared folder. A task numbers its rows, and for each length
   its pieces of that length (rank within the task); full pieces of `size` tokens and the remainder are told apart.
2. Count pieces by (task, length). Running sums over the tasks make the ranks global; the sums over all tasks are the histogram,
   which has at most `size` rows whatever the input holds.
3. Pack the histogram on the driver, longest length first, each piece into the pack with the most space left. Packs with equal
   content are an interval of sequence numbers (a pattern and its count); placing n pieces takes the interval's first n packs
   and leaves the rest as they are. The number of packs is fixed beforehand: all tokens fill them exactly, the last few being
   powers of two. A piece for which no pack has room is cut to fill the emptiest one; what is left of it is placed later.
4. Each step placed pieces a..a+n of a length into sequences s..s+n, so documents find their places by length and rank.
Ids are shuffled once, to meet their places.
"""
from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import staged, table

SIZE = 4_096
END = 2
PROBED = 0x2E80  # characters below are probed one by one
CACHED = 700_000  # cuts kept by a worker
LONGEST = 64  # longer ones are not kept
CHUNK = 1 << 20  # characters split at once
FLUSH = 16 << 20  # bytes of ids in one Arrow batch
BLOCK_ROWS = 100_000  # places broadcast at once
# the text rules of a lower-casing word tokenizer that can be followed word by word; fixed values
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def packed_ids(ids) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder(dict):
    """Ids as the tokenizer file's own library gives them. Where the file's rules are NORMAL and SPLIT, no piece crosses white space:
    texts of probed characters are cut there, and each distinct cut is encoded once and kept; all others go through the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.local = (rules.get("normalizer") == NORMAL and len(split) == 2 and split[0].get("pattern") == {"Regex": SPLIT} and split[0].get("invert")
                      and split[0].get("behavior") == "Removed" and split[1]["type"] == "ByteLevel" and not split[1]["add_prefix_space"]
                      and not split[1].get("use_regex", True) and rules["model"]["type"] == "BPE" and not rules["model"].get("dropout"))
        specials = [x.content for x in t.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        if self.local:
            from tokenizers.pre_tokenizers import ByteLevel

            pieces, shown = lambda s: len(t.pre_tokenizer.pre_tokenize_str(s)), ByteLevel(add_prefix_space=False, use_regex=False)
            letters, digits, spaces, odd = [], [], [], []
            for c in range(PROBED):
                ch = chr(c)
                kind = spaces if not pieces(ch) else letters if pieces("x" + ch) == 1 else digits if pieces("!" + ch) == 2 else None
                if kind is not None:
                    kind.append(c)
                # a capital sigma's lower case hangs on its place
                low = ch.lower()
                if ch.isspace() != (kind is spaces) or kind is not spaces and (c == 0x3A3 or len(low) != 1 or ord(low) >= PROBED or t.normalizer.normalize_str(ch) != low):
                    odd.append(c)
            a, n, s = _members(letters), _members(digits), _members(spaces)
            self.splitter = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{a}]+|[{n}]|[^{s}{a}{n}]+")
            self.beyond = re.compile(f"[{_members(odd)}]|[^\\u0000-\\u{PROBED - 1:04x}]")
            # the character that stands for each byte; bytes that no text holds stay as they are
            self.byte = {b: ch for c in [*range(0x80), *range(0x80, PROBED, 0x20), *range(0x80, 0xC0)] for b, ch in zip(chr(c).encode(), shown.pre_tokenize_str(chr(c))[0][0])}
            self.model = t.model

    def __missing__(self, cut: str) -> bytes:
        pieces = self.splitter.findall(cut)
        if len(pieces) > 1:
            out = b"".join(map(self.__getitem__, pieces))
        else:  # a cut without a piece holds white space only
            shown = cut if cut.isalpha() and cut.isascii() else cut.encode().decode("latin-1").translate(self.byte)
            out = packed_ids([x.id for x in self.model.tokenize(shown)]) if pieces else b""
        if len(cut) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[cut] = out
        return out

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.local or (self.special and self.special.search(text)) or self.beyond.search(text) or not unicodedata.is_normalized("NFC", text):
            return packed_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        out, at = [], 0
        while at < len(text):
            stop = text.find(" ", at + CHUNK)
            stop = len(text) if stop < 0 else stop
            out.append(b"".join(map(self.__getitem__, text[at:stop].lower().split())))
            at = stop
        return b"".join(out)


def _members(chars: list[int]) -> str:
    return "".join(f"\\u{c:04x}" for c in chars)


_ENCODERS: dict[str, Encoder] = {}  # one for each Python worker


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None, size: int) -> DataFrame:
    """task, row (place within the task), doc_id, n_tokens, ids, and the row's ranks within the task: of its full pieces' first, of its remainder."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("task", "row", "n_tokens", "full_rank", "rank")]
                          + [T.StructField("ids", T.BinaryType()), T.StructField("doc_id", kind)])
    tail = b"" if end_id is None else end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, row, full, ranks = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0, defaultdict(int)
        for batch in batches:
            names = batch.schema.names
            ids, rows, first, held = [], [], 0, 0
            keys, texts = batch.column(names.index("doc_id")), batch.column(names.index("text"))
            for k in range(batch.num_rows):
                own_ids = own.ids(texts[k].as_py()) + tail
                n = len(own_ids) // 4
                rows.append((task, row, n, full, ranks[n % size]))
                ids.append(own_ids)
                row, full, held = row + 1, full + n // size, held + len(own_ids)
                ranks[n % size] += 1
                if held > FLUSH or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.int64()) for c in zip(*rows)), pa.array(ids, pa.binary()), keys.slice(first, len(rows))],
                        names=[f.name for f in schema.fields])
                    ids, rows, first, held = [], [], k + 1, 0

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> tuple[list[tuple], int]:
    """Places for histogram[length] pieces of each length, and the number of sequences.

    A place (length, rank, n, start, tokens, sequence, offset): of the n pieces of that length from that rank on, the tokens from
    start on go to n sequences from that one on, each at that offset.
    """
    total = sum(n * c for n, c in histogram.items())
    packs = [(-size, 0, total // size, size)] if total >= size else []  # (-space, first sequence, count, capacity)
    n_sequences = total // size
    for bit in reversed(range(size.bit_length())):
        if total % size >> bit & 1:
            packs.append((-(1 << bit), n_sequences, 1, 1 << bit))
            n_sequences += 1
    heapq.heapify(packs)
    pieces = [(-n, n, 0, c, 0) for n, c in histogram.items() if n and c]  # (-tokens, length, rank, count, start)
    heapq.heapify(pieces)
    places = []
    while pieces:
        tokens, length, rank, left, start = heapq.heappop(pieces)
        tokens = -tokens
        while left:
            space, first, count, capacity = heapq.heappop(packs)
            space, n = -space, min(left, count)
            put = min(tokens, space)
            places.append((length, rank, n, start, put, first, capacity - space))
            if put < tokens:
                heapq.heappush(pieces, (put - tokens, length, rank, n, start + put))
            if put < space:
                heapq.heappush(packs, (put - space, first, n, capacity))
            if n < count:
                heapq.heappush(packs, (-space, first + n, count - n, capacity))
            rank, left = rank + n, left - n
    return places, n_sequences


PLACE = "length long, first long, n long, start long, tokens long, sequence long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = END, size: int = SIZE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit numbers), doc_tokens, sequence_id, offset.

    Sequences hold `size` tokens, the last few smaller powers of two, so none needs padding but to `size`. Null and empty texts
    are the end id alone; without an end id they have no piece. Repeated rows and null ids are documents of their own. Only
    doc_id and text are read. An empty table gives no rows. `tokenizer` is the path of a tokenizer file that every executor has.
    """
    spark = docs.sparkSession
    rows = staged(encoded(docs, tokenizer, end_id, size), "ids")
    light = rows.select("task", "row", "n_tokens", "full_rank", "rank")
    full, rest = F.call_function("div", F.col("n_tokens"), F.lit(size).cast("long")), F.col("n_tokens") % size
    kinds = F.array(F.struct(rest.alias("length"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(size).cast("long").alias("length"), full.alias("n")))
    per = light.select("task", F.inline(kinds)).where((F.col("length") > 0) & (F.col("n") > 0)).groupBy("length", "task").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    per = staged(per.select("length", "task", "n", F.coalesce(before, F.lit(0).cast("long")).alias("before")), "ranks")
    # at most `size` rows
    places, _ = shortest_pack_first({r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    offsets = per.select("length", "task", "before")
    remainders = light.where(rest > 0).select("task", "row", rest.alias("length"), (F.col("n_tokens") - rest).alias("base"), "rank")
    remainders = remainders.join(offsets, ["length", "task"]).withColumn("at", F.col("rank") + F.col("before"))
    found = []
    for k in range(0, max(1, len(places)), block_rows):  # a few thousand rows in all; more go out block by block
        block = F.broadcast(spark.createDataFrame([p for p in places[k:k + block_rows] if p[0] < size], PLACE))
        hit = remainders.join(block, "length").where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("n")))
        found.append(hit.select("task", "row", (F.col("base") + F.col("start")).alias("start"), F.col("tokens").alias("length"),
                                (F.col("sequence") + F.col("at") - F.col("first")).alias("sequence_id"), "offset"))
    # full pieces are the first to be placed: piece r of them is sequence r
    whole_ones = light.where(full > 0).withColumn("length", F.lit(size).cast("long")).join(offsets, ["length", "task"])
    whole_ones = whole_ones.select("task", "row", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("i"), (F.col("full_rank") + F.col("before")).alias("at"))
    found.append(whole_ones.select("task", "row", (F.col("i") * size).alias("start"), F.lit(size).cast("long").alias("length"), (F.col("at") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    # one row's pieces together: at most its tokens / size full ones, and its cuts
    own = reduce(DataFrame.union, found).groupBy("task", "row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    cut = F.transform("pieces", lambda p: F.struct(
        p["start"].alias("start"), p["length"].alias("length"),
        F.substring(F.col("ids"), (p["start"] * 4 + 1).cast("int"), (p["length"] * 4).cast("int")).alias("ids"), p["sequence_id"].alias("sequence_id"), p["offset"].alias("offset")))
    out = rows.select("task", "row", "doc_id", "n_tokens", "ids").join(own, ["task", "row"])
    out = out.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.explode(cut).alias("p"))
    return out.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
