"""File inventory: digests of whole files, read by tasks that are bounded."""
import hashlib
import random

from tidemark.sources import digests as D
from tidemark.sources import sinks as W

KB = 1024


def written(folder, lengths):
    r = random.Random(4)
    for name, n in lengths.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(r.randbytes(n))
    return {name: (n, hashlib.sha256((folder / name).read_bytes()).hexdigest()) for name, n in lengths.items()}


def found(df, folder):
    rows = df.collect()
    assert len({r.path for r in rows}) == len(rows)
    return {r.path.removeprefix(f"file:{folder}/"): (r.bytes, r.sha256) for r in rows}


def test_long_files_are_hashed_in_ranges(spark, tmp_path):
    want = written(tmp_path, {
        "short.bin": 100, "equal.bin": 64 * KB, "next.bin": 64 * KB + 1, "prime.bin": 611_953, "round.bin": 256 * KB, "slop.bin": 64 * KB * 11 // 10 + 1,
        "deep/a b,{c}[d]*?$.bin": 70_001, "deep/packed.gz": 90_001, "_k=1/_l=2.bin": 80_000, "_k=1/x.bin": 80_000})
    assert found(W.file_inventory(spark, str(tmp_path), 64 * KB), tmp_path) == want


def test_a_task_reads_a_range_and_not_the_file(spark, tmp_path, monkeypatch):
    want, read = written(tmp_path, {"a.bin": 1_000_003, "b.bin": 300_007}), []
    run = type(spark.sparkContext).runJob

    def seen(sc, rdd, func, partitions=None, **kw):
        out = run(sc, rdd, func, partitions, **kw)
        read.extend(n for _, _, n in out)
        return out

    monkeypatch.setattr(type(spark.sparkContext), "runJob", seen)
    assert found(W.file_inventory(spark, str(tmp_path), 64 * KB), tmp_path) == want
    assert sum(read) == 1_300_010 and max(read) <= 64 * KB


def test_splits_are_those_of_the_file_format(spark, tmp_path):
    for n in (1, 9, 10, 11, 12, 21, 22, 23, 110, 111, 119, 120, 121):
        written(tmp_path, {f"{n}.bin": n})
        assert D.byte_ranges(spark, [f"file:{tmp_path}/{n}.bin"], 10, 1).getNumPartitions() == D.full_splits(n, 10) + 1


def test_without_the_library_files_are_read_whole(spark, tmp_path, monkeypatch):
    want = written(tmp_path, {"a.bin": 100_003})
    monkeypatch.setattr(W, "resumable", lambda: False)
    assert found(W.file_inventory(spark, str(tmp_path), 64 * KB), tmp_path) == want
