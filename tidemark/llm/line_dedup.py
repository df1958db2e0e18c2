"""Line dedup with levelled sorted runs of line hashes.

The state is a list of immutable Parquet runs in the shared folder, each sorted by line hash. A batch of documents is
merge-joined with the runs: a key that some run already holds only adds to its count, a key that none holds (anti join)
enters with its holder. The batch's outcome becomes a new run at level 0; FAN_OUT runs of one level are compacted into one run
of the next. Batches are taken from the largest document ids down, so the first holder seen of a key is its largest document.
Only built-in functions run; no text is shuffled but for the final rewrite.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, ascii_lower, drop_staged, join_counted, staged, table

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FAN_OUT = 3
KEY = ["h1", "h2"]
RUN = "h1 long, h2 long, n_docs long, holder long"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    """The lines between newlines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line of a document with an id whose key is long enough: doc_id, the text's hash (tells rows of one doc_id apart), line number, 128-bit key hash."""
    known = docs.where(F.col("doc_id").isNotNull())
    lines = known.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineRuns:
    """Levelled sorted runs of (line hash, documents, holder)."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT):
        self.spark, self.fan_out, self.levels = spark, fan_out, {}

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels.values() for r in level]

    def merged(self) -> DataFrame:
        """One row per key over all runs."""
        runs = self.runs() or [self.spark.createDataFrame([], RUN)]
        return reduce(DataFrame.union, runs).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))

    def _store(self, run: DataFrame, level: int) -> None:
        self.levels.setdefault(level, []).append(staged(run.sortWithinPartitions(*KEY), f"run{level}"))
        if len(self.levels[level]) >= self.fan_out:
            old = self.levels.pop(level)
            whole = reduce(DataFrame.union, old).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))
            self._store(whole, level + 1)
            for r in old:
                drop_staged(r)

    def add(self, keys: DataFrame) -> None:
        """keys: (h1, h2, doc_id) of one batch. Documents of a batch must not occur in another one."""
        batch = keys.groupBy(*KEY).agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("holder"))
        if self.runs():
            known = reduce(DataFrame.union, [r.select(*KEY) for r in self.runs()]).hint("merge")
            fresh = batch.join(known, KEY, "left_anti")
            seen = batch.join(known, KEY, "left_semi").withColumn("holder", F.lit(None).cast("long"))
            batch = fresh.union(seen)
        self._store(batch.select("h1", "h2", F.col("n_docs").cast("long").alias("n_docs"), "holder"), 0)


def id_batches(docs: DataFrame, batches: int) -> Column:
    """Batch number of a doc_id, 0 for the largest ids; cut at approximate quantiles, so any spread of ids gives batches alike in size."""
    shares = [b / batches for b in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] if shares else None
    return F.coalesce(sum(((F.col("doc_id") <= F.lit(c)).cast("int") for c in set(cuts or [])), F.lit(0)), F.lit(0))


def repeated_lines(hashes: DataFrame, docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """Keys found in at least min_docs documents with their holder, gathered batch by batch through levelled runs."""
    runs = LineRuns(docs.sparkSession)
    batch = id_batches(docs, batches)
    for b in range(batches):
        runs.add(hashes.where(batch == b).select(*KEY, "doc_id"))
    return runs.merged().where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """All columns of docs with `text` rewritten, plus n_lines and n_dropped.

    Lines whose stripped, A-Z lower-cased key has min_chars code points and occurs in min_docs documents stay only in the
    largest doc_id that holds the key (all of its copies there). Null and empty texts: one empty line, text ''. Rows that share
    a doc_id count as one document. A null doc_id adds to no count and its lines stay. Empty tables give empty tables. A column
    of docs named n_lines or n_dropped is replaced; other columns pass through.
    """
    hashes = staged(line_hashes(docs.select("doc_id", "text"), min_chars), "lines")
    keys = repeated_lines(hashes, docs, min_docs, batches)
    hit = join_counted(hashes, staged(keys, "keys"), KEY, "n_docs").where(F.col("doc_id") != F.col("holder"))
    drops = hit.groupBy(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).agg(F.collect_set("pos").alias("_drop"))
    full = docs.drop("n_lines", "n_dropped").withColumn("_row", F.xxhash64("text"))
    full = full.join(drops, (F.col("doc_id") == F.col("_d")) & (F.col("_row") == F.col("_r")), "left")
    lines = lines_of(F.col("text"))
    rest = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(rest, lambda i: F.get("_lines", i)), "\n"))
    full = full.withColumn("_lines", lines)
    return full.select(
        *[kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), generate_series(1, len(lines)) AS g(i)),
k AS (SELECT key, max(doc_id) AS holder FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.holder AS dropped FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
