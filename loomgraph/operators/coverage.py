"""Line coverage: run-length coding, attribution to the innermost node, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(lines: DataFrame) -> DataFrame:
    """Runs of neighbouring lines of one state: file, start, end, hit; input file, line, hit."""
    w = Window.partitionBy("file").orderBy("line")
    new = (F.col("line") != F.lag("line").over(w) + 1) | (F.col("hit") != F.lag("hit").over(w))
    run = F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w)
    return lines.withColumn("run", run).groupBy("file", "run").agg(F.min("line").alias("start"), F.max("line").alias("end"), F.first("hit").alias("hit")).drop("run")


def lines_of(coded: DataFrame) -> DataFrame:
    return coded.select("file", F.explode(F.sequence("start", "end")).alias("line"), "hit")


def totals(lines: DataFrame) -> DataFrame:
    hit = F.count_if("hit")
    return lines.groupBy("file").agg(hit.alias("covered"), (F.count("*") - hit).alias("uncovered"), F.round(100.0 * hit / F.count("*"), 6).alias("pct"))


def innermost(lines: DataFrame, spans: DataFrame, bucket: int = 1024) -> DataFrame:
    """Each line's smallest span (file, id, start, end); ties by id.  A range join by equal buckets of lines."""
    spans = spans.groupBy("file", "start", "end").agg(F.min("id").alias("id"))  # of spans of the same lines the least id has them all
    keyed = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    own = lines.withColumn("bucket", F.floor(F.col("line") / bucket))
    hits = own.join(keyed, ["file", "bucket"]).filter("line between start and end")
    return hits.groupBy("file", "line").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("size"), "id")).alias("s"), F.first("hit").alias("hit")).select("file", "line", F.col("s.id").alias("id"), "hit")


def stale(coverage: DataFrame, files: DataFrame) -> DataFrame:
    """Coverage rows with a flag: the file's hash has changed since."""
    now = files.select("path", F.col("hash").alias("now"))
    return coverage.join(now, "path", "left").withColumn("stale", ~F.col("hash").eqNullSafe(F.col("now"))).drop("now")


def profile_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of a cover profile given as lines (value): file, start, end, statements, count; the mode line and others that don't fit are left out."""
    pattern = r"^(.+):(\d+)\.(\d+),(\d+)\.(\d+) (\d+) (\d+)$"
    # a line that fits is cut at its marks, which takes less than a match for each field
    rest = F.substring_index("value", ":", -1)
    file = F.col("value").substr(F.lit(1), F.length("value") - F.length(rest) - 1)
    upto, words = F.substring_index(rest, ",", -1), F.split(rest, " ")
    first = lambda c: F.substring_index(c, ".", 1).cast("int")
    return lines.filter(F.col("value").rlike(pattern)).select(file.alias("file"), first(rest).alias("start"), first(upto).alias("end"), words[1].cast("int").alias("statements"), words[2].cast("long").alias("count"))


def block_lines(blocks: DataFrame) -> DataFrame:
    """file, line, hit: a line is hit if any block over it was."""
    # a profile of many runs has a block many times: its lines are listed once
    once = blocks.filter("end >= start").groupBy("file", "start", "end").agg(F.max(F.col("count") > 0).alias("hit"))
    lines = once.select("file", F.explode(F.sequence(F.greatest("start", F.lit(1)), "end")).alias("line"), "hit")
    return lines.groupBy("file", "line").agg(F.max("hit").alias("hit"))


def ingest(lines: DataFrame, files: DataFrame, module: str = "") -> tuple[DataFrame, DataFrame]:
    """Lines with the path of their file in the repository, and the files of the profile that aren't there.  ``module`` is taken off the names' front."""
    own = F.col("file") if not module else F.when(F.col("file").startswith(module + "/"), F.substring(F.col("file"), len(module) + 2, 1 << 20)).otherwise(F.col("file"))
    named = lines.withColumn("path", own)
    known = files.select("path")
    return named.join(known, "path", "left_semi").select(F.col("path").alias("file"), "line", "hit"), named.join(known, "path", "left_anti").select("file").distinct()


def file_coverage(lines: DataFrame) -> DataFrame:
    """file, ranges (start, end, kind), covered, uncovered, pct."""
    coded = runs(lines).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.when(F.col("hit"), "hit").otherwise("miss").alias("kind")))).alias("ranges"))
    return coded.join(totals(lines), "file")


def node_coverage(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """id, covered, uncovered and pct of every span with lines of its own: those that no smaller span has."""
    own = innermost(lines, spans)
    hit = F.count_if("hit")
    return own.groupBy("id").agg(hit.alias("covered"), F.count_if(~F.col("hit")).alias("uncovered"), F.round(100.0 * hit / F.count("*"), 6).alias("pct"))


def violations(coverage: DataFrame) -> DataFrame:
    """Rows that can't be: runs out of order or overlapping, empty ones, counts that don't fit them."""
    lines = lambda kind: F.aggregate(F.filter("ranges", lambda r: r["kind"] == kind), F.lit(0), lambda a, r: a + (r["end"] - r["start"] + 1).cast("int"))
    order = F.exists(F.arrays_zip(F.slice("ranges", 1, F.greatest(F.size("ranges") - 1, F.lit(0))).alias("a"), F.slice("ranges", 2, F.greatest(F.size("ranges"), F.lit(1))).alias("b")), lambda z: z["b"]["start"] <= z["a"]["end"])
    bad = F.exists("ranges", lambda r: (r["end"] < r["start"]) | (r["start"] < 1)) | order | (lines("hit") != F.col("covered")) | (lines("miss") != F.col("uncovered"))
    return coverage.filter(bad)
