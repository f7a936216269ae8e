"""Array kernels as higher-order functions: quantisation, products, norms, sampling scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, f) -> Column:
    """f(value) with the value formed once a row, however often f uses it inside lambdas."""
    return F.transform(F.array(value), f)[0]


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def finite(a: Column) -> Column:
    """NaN and infinities to 0."""
    return F.transform(doubles(a), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def groups(a: Column, size: int) -> Column:
    """The array in slices of `size`."""
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda g: F.slice(v, g * size + 1, size))
    return bound(a, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(F.array().cast("array<array<double>>")))


def scales(a: Column, size: int, bits: int) -> Column:
    top = float(2 ** (bits - 1) - 1)
    return F.transform(groups(doubles(a), size), lambda g: F.greatest(F.array_max(F.transform(g, F.abs)) / top, F.lit(1e-8)))


def quantize(a: Column, size: int, bits: int) -> Column:
    """Codes by group, rounded half to even and clamped."""
    top = 2 ** (bits - 1) - 1
    code = lambda x, scale: F.least(F.greatest(F.rint(x / scale), F.lit(float(-top))), F.lit(float(top))).cast("int")
    return bound(scales(a, size, bits), lambda s: F.transform(doubles(a), lambda x, i: code(x, F.element_at(s, (F.floor(i / size) + 1).cast("int")))))


def dequantize(codes: Column, s: Column, size: int) -> Column:
    return bound(s, lambda v: F.transform(codes, lambda q, i: q * F.element_at(v, (F.floor(i / size) + 1).cast("int"))))


def pack_nibbles(codes: Column) -> Column:
    """Two codes + 8 a byte, the even one low."""
    at = lambda v, i: F.coalesce(F.try_element_at(v, i), F.lit(0)) + 8
    return bound(codes, lambda v: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / 2).cast("int") - 1), lambda k: at(v, 2 * k + 1).bitwiseOR(F.shiftleft(at(v, 2 * k + 2), 4))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def rms_norm(a: Column, eps: float = 1e-6) -> Column:
    factor = lambda d: 1 / F.sqrt(_sum(F.transform(d, lambda x: x * x)) / F.size(d) + eps)
    return bound(doubles(a), lambda d: bound(factor(d), lambda r: F.transform(d, lambda x: x * r)))


def _exps(a: Column) -> Column:
    """exp(x - max) of each element."""
    return bound(doubles(a), lambda d: bound(F.array_max(d), lambda top: F.transform(d, lambda x: F.exp(x - top))))


def softmax(a: Column) -> Column:
    return bound(_exps(a), lambda e: bound(_sum(e), lambda s: F.transform(e, lambda x: x / s)))


def cross_entropy(a: Column, target: Column) -> Column:
    return F.log(_sum(_exps(a))) + F.array_max(doubles(a)) - F.element_at(doubles(a), target + 1)


def matvec_row(codes: Column, s: Column, x: Column, size: int) -> Column:
    """Product of one quantised row with a vector: the sum over groups of scale times the sum of code times element."""
    return dot(dequantize(codes, s, size), x)


def penalised(logits: Column, seen: Column, penalty: float) -> Column:
    """Each logit divided by the penalty once for every time its index was seen, whatever its sign."""
    return F.transform(doubles(logits), lambda x, i: x / F.pow(F.lit(penalty), F.size(F.filter(seen, lambda t: t == i))))


def sampled(probabilities: Column, draw: Column) -> Column:
    """The first index whose running probability exceeds the draw; the last one where rounding leaves none."""
    step = lambda acc, p: F.struct((acc["total"] + p).alias("total"), F.when(acc["at"] >= 0, acc["at"]).when(acc["total"] + p > draw, acc["n"]).otherwise(-1).alias("at"), (acc["n"] + 1).alias("n"))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(-1).alias("at"), F.lit(0).alias("n"))
    return F.aggregate(probabilities, start, step, lambda acc: F.when(acc["at"] >= 0, acc["at"]).otherwise(acc["n"] - 1))


def xorshift(x: Column) -> Column:
    """One step of the 32-bit generator with shifts 13, 17, 5, over INT."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 17))
    return x.bitwiseXOR(F.shiftleft(x, 5))


def learning_rate(step: Column, warm: int, total: int, peak: float) -> Column:
    """Linear warm-up, then a cosine down to a tenth of the peak."""
    share_ = (step - warm) / float(max(1, total - warm))
    return F.when(step < warm, peak * (step + 1) / float(warm)).otherwise(peak * (0.1 + 0.45 * (1 + F.cos(F.lit(3.141592653589793) * F.least(share_, F.lit(1.0))))))


def gelu(x: Column) -> Column:
    """x times the normal distribution function; erf by the five-term rational approximation (error under 1.5e-7)."""
    z = F.abs(x) / 1.4142135623730951
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z)
    return 0.5 * x * (1 + F.when(x < 0, -erf).otherwise(erf))


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def top_k_kept(a: Column, k: int) -> Column:
    """Values at or above the k-th largest; ties stay."""
    floor = lambda d: F.element_at(F.sort_array(d, asc=False), F.least(F.lit(k), F.size(d)))
    return bound(doubles(a), lambda d: bound(floor(d), lambda v: F.filter(d, lambda x: x >= v)))


def rotate(a: Column, position: Column, theta: float = 10000.0) -> Column:
    """Split-half rotary embedding at a position."""
    d, half = doubles(a), (F.size(a) / 2).cast("int")
    x, y = F.slice(d, F.lit(1), half), F.slice(d, half + 1, half)
    angle = lambda i: position / F.pow(F.lit(theta), i.cast("double") / half)
    left = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p, i: p["x"] * F.cos(angle(i)) - p["y"] * F.sin(angle(i)))
    right = F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p, i: p["x"] * F.sin(angle(i)) + p["y"] * F.cos(angle(i)))
    return F.concat(left, right)


def as_halves(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column) with every value rounded to an IEEE half."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float64)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
            out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], [key, column])

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, {column} array<double>")
