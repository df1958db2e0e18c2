"""SHA-256 of long files in ranges: one chain over the bytes, whose state is handed from task to task."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate, zip_longest

from pyspark import RDD
from pyspark.sql import SparkSession

#: SHA256_CTX of OpenSSL: eight words of state, two of the bit count, sixteen of the open block, two counters.
STATE_BYTES = 4 * 28
#: FileInputFormat leaves up to 1.1 times the split size to the last split.
SLOP = 1.1


def sha256_library() -> ctypes.CDLL:
    """The library behind hashlib; unlike a hashlib object, its state is a plain structure."""
    import _hashlib

    lib = ctypes.CDLL(_hashlib.__file__)
    lib.SHA256_Init.argtypes = [ctypes.c_char_p]
    lib.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
    lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_char_p]
    return lib


def resumable() -> bool:
    try:
        return bool(sha256_library())
    except (ImportError, OSError, AttributeError):
        return False


def begin() -> bytes:
    state = ctypes.create_string_buffer(STATE_BYTES)
    sha256_library().SHA256_Init(state)
    return state.raw


def resume(state: bytes, parts: Iterable[bytes]) -> tuple[bytes, int]:
    """The state after further bytes, and their number."""
    lib, held, n = sha256_library(), ctypes.create_string_buffer(state, STATE_BYTES), 0
    for x in parts:
        lib.SHA256_Update(held, bytes(x), len(x))
        n += len(x)
    return held.raw, n


def digest(state: bytes) -> str:
    held, out = ctypes.create_string_buffer(state, STATE_BYTES), ctypes.create_string_buffer(32)
    sha256_library().SHA256_Final(out, held)
    return out.raw.hex()


def full_splits(length: int, size: int) -> int:
    """Splits of ``size`` before the last one of a file."""
    n = max(length // size - 1, 0)
    while (length - n * size) / size > SLOP:
        n += 1
    return n


def byte_ranges(spark: SparkSession, paths: Sequence[str], size: int, record: int) -> RDD:
    """Records of the files' bytes, a partition per ``size`` bytes, files in the given order."""
    names = (re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths)
    return spark.sparkContext.newAPIHadoopRDD(
        "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={"mapreduce.input.fileinputformat.inputdir": ",".join(re.sub(r"([\\,])", r"\\\1", n) for n in names),
              "mapreduce.input.fileinputformat.list-status.num-threads": "1",
              "mapreduce.input.fileinputformat.split.minsize": str(size), "mapreduce.input.fileinputformat.split.maxsize": str(size),
              "org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(record)})


def resumed(states: dict[int, bytes]) -> Callable[[int, Iterator], Iterator]:
    return lambda k, rows: iter([(k, *resume(states[k], (x for _, x in rows)))])


def long_files_sha256(spark: SparkSession, files: Sequence[tuple[str, int]], whole: int) -> list[tuple[str, int, str]]:
    """Path, length and digest of files longer than ``whole``; the next ranges of all files are read by one job.

    A last split ends inside a record, so the ranges of ``whole`` bytes are followed by ones of a sixteenth, then of a
    sixteenth of that; the last split of those, up to 1.1 times their size, is read by the byte.
    """
    unit = max(whole // 256, 1)
    states, done = [begin()] * len(files), [0] * len(files)
    for size, record, last in ((256 * unit, unit, False), (16 * unit, unit, False), (unit, unit, False), (unit, 1, True)):
        ranges = byte_ranges(spark, [p for p, _ in files], size, record)
        full = [full_splits(n, size) for _, n in files]
        first = list(accumulate((n + 1 for n in full), initial=0))
        if ranges.getNumPartitions() != first[-1]:
            raise RuntimeError("files changed while they were read")
        todo = [[first[i] + k for k in ([n] if last else range(done[i] // size, n))] for i, n in enumerate(full)]
        for wave in zip_longest(*todo):
            at = {k: i for i, k in enumerate(wave) if k is not None}
            step = ranges.mapPartitionsWithIndex(resumed({k: states[i] for k, i in at.items()}))
            for k, state, n in spark.sparkContext.runJob(step, list, sorted(at)):
                states[at[k]], done[at[k]] = state, done[at[k]] + n
    if done != [n for _, n in files]:
        raise RuntimeError("files changed while they were read")
    return [(p, n, digest(s)) for (p, n), s in zip(files, states)]
