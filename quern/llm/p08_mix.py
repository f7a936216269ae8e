"""Problem 8: mixing sources to target weights.

The mix is as large, in tokens of a public tokenizer, as all documents together. Entropy
balancing asks for the document rates nearest (in relative entropy) to "each document
once" that meet each source's token target with no rate above the source's repeat cap.
They are exponentially tilted, rate = min(cap, exp(multiplier * tokens / mean)), with one
multiplier a source: the variables of the convex dual. Newton steps on the dual are
distributed sums over (source, tokens) counts, with one multiplier a source.
Rates are rounded into whole copies by a hash of the document's id.

Where the dual is unbounded (all rates at the cap, a gap left) a source can't reach its
target: its rates are the cap. Null or empty texts have no tokens. Documents of a
source without a target (a null source, too) are left out. A null weight counts as 0, a
null cap as 1; a source listed twice gets the sum of its weights and its smallest cap.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import BROADCAST_ROWS, cut_lineage, sized_join
from quern.sources.tables import table

TOKENIZER = os.environ.get("QUERN_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pre-split pattern that goes with byte-level BPE vocabularies of this kind.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Relative gap to a target at which a Newton iteration ends.
CLOSE = 1e-9
_LOADED: dict = {}


def tokenizer(vocabulary: bytes):
    """The tokenizer of a vocabulary file's content, built once in a process."""
    key = hash(vocabulary)
    if key not in _LOADED:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _LOADED[key] = tiktoken.Encoding("quern", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def _counter(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(vocabulary.value)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of `docs(doc_id, source, text)`, whole texts; the driver reads the vocabulary and sends it along."""
    with open(path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(_counter(vocabulary), "doc_id long, source string, tokens long")


_STATE = "source string, cap double, tokens long, target double, mean double, least double, most double, low double, high double, m double, gap double, reachable boolean, done boolean"

_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def _steps(forced: bool):
    """One guarded Newton step for the open rows of a state joined with the mass f at the multiplier, its slope d and the mass below the cap."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s in frames:
            f, d, below = (s[k].fillna(0.0).to_numpy() for k in ("f", "d", "below"))
            m, least, most = (s[k].to_numpy() for k in ("m", "least", "most"))
            gap = f - s["target"].to_numpy()
            met = np.abs(gap) <= CLOSE * np.maximum(1.0, s["target"].to_numpy())
            low, high = np.where(gap < 0, m, s["low"].to_numpy()), np.where(gap > 0, m, s["high"].to_numpy())
            # the dual has no maximum where its gradient stays positive however far the multiplier runs: every rate is at the cap and a gap is left
            endless = ~met & (gap < 0) & (below == 0)
            narrow = (low > least) & (high < most) & (high - low <= 1e-13 * np.maximum(1.0, np.abs(m)))
            stride = 2 * np.maximum(1.0, np.abs(m))
            with np.errstate(divide="ignore", invalid="ignore"):
                newton = np.where(d > 0, m - gap / d, np.where(gap < 0, m + stride, m - stride))
            inside = np.where((newton > low) & (newton < high) & (not forced), newton, (low + high) / 2)
            up, down = np.minimum(np.minimum(newton, m + stride), most), np.maximum(np.maximum(newton, m - stride), least)
            trial = np.where((gap < 0) & (high >= most), up, np.where((gap > 0) & (low <= least), down, inside))
            over = met | endless | narrow
            yield s.assign(low=low, high=high, gap=gap, m=np.where(over, m, trial), reachable=~endless, done=over).drop(columns=["f", "d", "below"])

    return run


def balance(counted: DataFrame, targets: DataFrame, total: int | None = None, held_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each source of `targets`: tokens there are, target, cap, whether it can be reached, multiplier, mean and gap left.

    `counted(source, tokens, docs)` says how many documents of a source have so many
    tokens; it is read once a Newton step. The multipliers of up to `held_rows` sources are
    kept by the driver, those of more are a table checkpointed after each step; the steps
    end when no source is open. A source is found unreachable in the dual: its multiplier runs up until every rate is at the cap
    and the gradient is still positive. Without documents a source with a positive target
    can't reach it.
    """
    spark = counted.sparkSession
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.min(F.coalesce("max_repeat", F.lit(1))).cast("double").alias("cap"))
    mass = F.col("tokens") * F.col("docs")
    there = counted.groupBy("source").agg(F.sum(mass).alias("all"), F.sum("docs").alias("docs"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("short"))
    if total is None:
        total = counted.agg(F.coalesce(F.sum(mass), F.lit(0))).collect()[0][0]
    start = wanted.join(there, "source", "left").select("source", "cap", F.coalesce("all", F.lit(0)).alias("tokens"), (F.col("weight") * total).alias("target"), F.greatest(F.lit(1.0), F.coalesce(F.col("all") / F.col("docs"), F.lit(1.0))).alias("mean"), "short")
    x_least = F.coalesce(F.col("short") / F.col("mean"), F.lit(1.0))
    bounds = start.withColumns({"least": -60.0 / x_least, "most": (F.log(F.greatest(F.col("cap"), F.lit(1.0))) + 1) / x_least})
    open_ = cut_lineage(bounds.select("*", F.col("least").alias("low"), F.col("most").alias("high"), F.lit(0.0).alias("m"), F.lit(0.0).alias("gap"), F.lit(True).alias("reachable"), (F.col("target") <= 0).alias("done")).drop("short").select(*_NAMES))
    few = open_.count() <= held_rows
    settled, open_ = open_.where("done"), open_.where("not done")
    x = F.col("tokens") / F.col("mean")
    raw = F.exp(F.least(F.col("m") * x, F.lit(60.0)))

    def sums(now: DataFrame) -> DataFrame:
        held = counted.join(F.broadcast(now) if few else now, "source")
        return held.groupBy("source").agg(F.sum(mass * F.least(raw, "cap")).alias("f"), F.sum(F.when(raw <= F.col("cap"), mass * x * raw).otherwise(0.0)).alias("d"), F.sum(F.when(raw < F.col("cap"), mass).otherwise(0)).cast("double").alias("below"))

    rounds = 0
    if few:  # one row a source on the driver, counted above
        frame, ended = open_.toPandas(), []
        while len(frame):
            rounds += 1
            at = sums(spark.createDataFrame(frame[["source", "m", "mean", "cap"]], "source string, m double, mean double, cap double")).toPandas()
            frame = next(_steps(rounds % 3 == 0)([frame.merge(at, on="source", how="left")]))
            ended.append(frame[frame["done"]])
            frame = frame[~frame["done"]]
        if ended:
            settled = settled.union(spark.createDataFrame(pd.concat(ended)[_NAMES], _STATE))
    else:
        while not open_.isEmpty():
            rounds += 1
            state = cut_lineage(open_.join(sums(open_.select("source", "m", "mean", "cap")), "source", "left").select(*_NAMES, "f", "d", "below").mapInPandas(_steps(rounds % 3 == 0), _STATE))
            settled, open_ = settled.union(state.where("done")), state.where("not done")
    return settled.select("source", "tokens", "target", "cap", "reachable", F.col("m").alias("multiplier"), "mean", "gap")


def _counted(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("source", "tokens").agg(F.count("*").alias("docs"))


def copies(tokens: DataFrame, solved: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, copies): rates rounded down, and up where the id's hash falls under the fraction."""
    rate = F.when(~F.col("reachable"), F.col("cap")).when(F.col("target") <= 0, 0.0).otherwise(F.least(F.exp(F.least(F.col("multiplier") * F.col("tokens") / F.col("mean"), F.lit(60.0))), "cap"))
    joined = sized_join(tokens, solved.drop("tokens"), ["source"]).withColumn("rate", rate)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return joined.select("doc_id", "source", "tokens", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies"))


def _solve(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents", ["doc_id", "source", "text"])
    tokens = cut_lineage(token_counts(docs))
    return tokens, balance(cut_lineage(_counted(tokens)), table(spark, folder, "mix_target"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of every document that has a target."""
    tokens, solved = _solve(spark, folder)
    return copies(tokens, solved)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source."""
    tokens, solved = _solve(spark, folder)
    reached = cut_lineage(copies(tokens, solved).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed")))
    whole = reached.agg(F.coalesce(F.sum("mixed"), F.lit(0))).collect()[0][0] or 1
    aim = solved.agg(F.coalesce(F.sum("target"), F.lit(0.0))).collect()[0][0] or 1.0
    out = solved.join(reached, "source", "left")
    return out.select("source", (F.col("target") / aim).alias("target_share"), (F.coalesce("mixed", F.lit(0)) / whole).alias("reached_share"), F.coalesce("mixed", F.lit(0)).alias("mixed_tokens"), "reachable")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources whose dual is unbounded."""
    docs = table(spark, folder, "documents", ["doc_id", "source", "text"])
    solved = balance(cut_lineage(_counted(token_counts(docs))), table(spark, folder, "mix_target"))
    return solved.where("not reachable").select("source")


QUERIES = {"p8_found": p8_found, "p8_mix": p8_mix, "p8_shares": p8_shares}
ORACLES: dict[str, str] = {}
