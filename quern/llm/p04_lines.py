"""Problem 4: lines repeated across one site's documents.

A line is known by its letters. For every line and source the number of files that hold
it is compared with the files of other sources by a log-likelihood ratio; the false
discovery rate over all lines is held at `FDR`. Significant lines that also stand in at
least `MIN_FILES` files and `MIN_SHARE` of the source's files are the site's own; they
are taken out by an anti-join and the rest is put together again by position.

A null source is a source of its own. Null and empty texts have no lines. A file that
comes several times counts once. Lines without letters are never removed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._text import letters_only
from quern.session import cut_lineage, sized_join
from quern.sources.tables import table

FDR, MIN_FILES, MIN_SHARE = 0.05, 3, 0.2
#: Bins of the statistic's histogram: width 0.25 up to 2,000; the last bin holds the rest.
BIN, BINS = 0.25, 8001


def line_key(line: str) -> int | None:
    """A signed 64-bit hash of the line's letters; None without letters."""
    letters = letters_only(line)
    if not letters:
        return None
    h = xxhash.xxh3_64_intdigest(letters)
    return h - (1 << 64) if h >> 63 else h


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct line keys of each file."""
    for batch in batches:
        ids, sources, texts = (batch.column(k).to_pylist() for k in range(3))
        counts, keys = [], []
        for text in texts:
            own = {k for line in text.split("\n") if (k := line_key(line)) is not None} if text else ()
            counts.append(len(own))
            keys += own
        at = np.repeat(np.arange(len(ids)), counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(at)), pa.array(sources, pa.string()).take(pa.array(at)), pa.array(keys, pa.int64())], ["text_id", "source", "key"])


def _lines(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if text is not None:
                    for n, line in enumerate(text.split("\n"), 1):
                        h = line_key(line)
                        if h is not None or with_text:
                            out.append((key, source, n, h, line))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string())
            names = ("text_id", "source", "line_no", "key", "line")
            width = 5 if with_text else 4
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(width)], list(names[:width]))

    return run


def _ratio(a: Column, b: Column, n_in: Column, n_out: Column) -> Column:
    """Signed log-likelihood ratio of a of n_in against b of n_out."""
    total = a + b
    rate = total / (n_in + n_out)

    def part(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    g = 2 * (part(a, rate * n_in) + part(b, rate * n_out) + part(n_in - a, (1 - rate) * n_in) + part(n_out - b, (1 - rate) * n_out))
    return F.when(a * n_out > b * n_in, g).otherwise(-g)


def _threshold(histogram: np.ndarray, tests: int) -> float:
    """Benjamini-Hochberg: the least statistic whose tail probability is at most FDR times its share of the tests."""
    above, best = 0, math.inf
    for k in range(len(histogram) - 1, -1, -1):
        above += int(histogram[k])
        if above and math.erfc(math.sqrt(k * BIN / 2)) <= FDR * above / tests:
            best = k * BIN
    return best


def site_lines(pages: DataFrame) -> DataFrame:
    """(source, key, files, share, ratio): the lines that stand out in their source.

    Beside the files of other sources, as many files as the source has itself, all
    without the line, count as outside, so that a lone source can be judged too. Counts
    are taken over (source, key, file) first, which spreads a line that fills a source
    over all tasks, and only then by (source, key).
    """
    keyed = pages.mapInArrow(_keys, "text_id long, source string, key long").distinct()
    files = keyed.groupBy("source", "key").agg(F.count("*").alias("files"))
    sizes = pages.select("text_id", "source").distinct().groupBy("source").agg(F.count("*").alias("n_in"))
    files = sized_join(files, sizes, ["source"]).persist()
    try:
        everywhere = files.groupBy("key").agg(F.sum("files").alias("all_files"))
        n_all = sizes.agg(F.sum("n_in")).collect()[0][0] or 0
        # a line in fewer files can't be significant enough to matter; it still counts as a test
        tests = files.count()
        scored = files.where(F.col("files") >= MIN_FILES).join(everywhere, "key")
        n_in = F.col("n_in").cast("double")
        scored = scored.withColumn("ratio", _ratio(F.col("files").cast("double"), (F.col("all_files") - F.col("files")).cast("double"), n_in, F.lit(float(n_all)) - n_in + n_in))
        scored = scored.select("source", "key", "files", (F.col("files") / F.col("n_in")).alias("share"), "ratio")
        bins = scored.where("ratio > 0").groupBy(F.least(F.floor(F.col("ratio") / BIN), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
        histogram = np.zeros(BINS, dtype=np.int64)
        for r in bins:
            histogram[r.bin] = r.n
        least = _threshold(histogram, max(1, tests))
        out = scored.where((F.col("ratio") >= F.lit(least)) & (F.col("files") >= MIN_FILES) & (F.col("share") >= MIN_SHARE))
        return cut_lineage(out)
    finally:
        files.unpersist()


def marked_lines(pages: DataFrame) -> DataFrame:
    """(text_id, line_no) of every occurrence of a site's own line."""
    lines = pages.mapInArrow(_lines(False), "text_id long, source string, line_no int, key long")
    return sized_join(lines, site_lines(pages).select("source", "key"), ["source", "key"], "left_semi").select("text_id", "line_no").distinct()


def without_site_lines(pages: DataFrame) -> DataFrame:
    """(text_id, text) without the site's own lines; a file that holds nothing else comes back empty."""
    one = pages.dropDuplicates(["text_id"])
    lines = one.mapInArrow(_lines(True), "text_id long, source string, line_no int, key long, line string")
    kept = sized_join(lines, site_lines(pages).select("source", "key"), ["source", "key"], "left_anti")
    texts = kept.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    texts = texts.select("text_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    return one.select("text_id", F.col("text").isNull().alias("no_text")).join(texts, "text_id", "left").select("text_id", F.when(~F.col("no_text"), F.coalesce("text", F.lit(""))).alias("text"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    web = table(spark, folder, "prepare_file").where("origin = 'web'")
    return web.select(F.col("text_id").cast("long").alias("text_id"), F.coalesce("source", F.lit("\u0001")).alias("source"), "text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return marked_lines(_pages(spark, folder))


def p4_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every web page without its site's own lines."""
    return without_site_lines(_pages(spark, folder))


QUERIES = {"p4_found": p4_found, "p4_cleaned": p4_cleaned}
ORACLES: dict[str, str] = {}
