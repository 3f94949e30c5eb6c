"""Column functions on array columns. All sums are in double precision; elements are cast on the way in.

Arithmetic is IEEE where Spark's isn't: division by zero gives an infinity or NaN, and logarithms of numbers
below zero give NaN. Functions of two vectors fail on different lengths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
_EMPTY = lambda kind: F.array().cast(f"array<{kind}>")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def doubles(v) -> Column:
    return _c(v).cast("array<double>")


def longs(v) -> Column:
    return _c(v).cast("array<bigint>")


# --- scalars


def ieee_div(x: Column, y: Column) -> Column:
    return F.when(y != 0, x / y).otherwise(F.when((x == 0) | F.isnan(x), NAN).otherwise(F.signum(x) * INF))


def ieee_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, -INF).otherwise(NAN)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != INF)


def _let(value: Column, f) -> Column:
    """f(value) with the value worked out once: what a lambda takes from outside is worked out for each element."""
    return F.get(F.transform(F.array(value), f), 0)


def _both(a, b, f, kind=doubles) -> Column:
    a, b = kind(a), kind(b)
    checked = F.when(F.size(a) == F.size(b), b).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<double>" if kind is doubles else "array<bigint>"))
    return F.zip_with(a, checked, f)


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


# --- constructors


def constant(n: int | Column, value: float = 0.0) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def int_range(a, b) -> Column:
    """a, a + 1, ... b - 1; empty if a >= b."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return F.when(a < b, F.sequence(a.cast("bigint"), b.cast("bigint") - 1)).otherwise(_EMPTY("bigint"))


def resize(v, n: int, fill: float = 0.0) -> Column:
    """The first n elements, filled up at the end."""
    v = doubles(v)
    return F.slice(F.concat(v, F.array_repeat(F.lit(float(fill)), n)), 1, n)


def hadamard_row(i: Column, d: int) -> Column:
    """Row i of the Sylvester matrix of order d, a power of two."""
    if d & (d - 1):
        raise ValueError("the order must be a power of two")
    return F.transform(int_range(0, d), lambda j: F.when(F.bit_count(i.cast("bigint").bitwiseAND(j)) % 2 == 0, 1.0).otherwise(-1.0))


def reverse(v) -> Column:
    return F.reverse(_c(v))


# --- elementwise


def add_scalar(v, c: float) -> Column:
    return F.transform(doubles(v), lambda x: x + c)


def scale(v, c) -> Column:
    return F.transform(doubles(v), lambda x: x * c)


def divide_scalar(v, c) -> Column:
    c = c if isinstance(c, Column) else F.lit(float(c))
    return _let(c, lambda y: F.transform(doubles(v), lambda x: ieee_div(x, y)))


def divided_scalar(v, c: float) -> Column:
    """c / v."""
    return F.transform(doubles(v), lambda x: ieee_div(F.lit(float(c)), x))


def int_mod(v, c: int) -> Column:
    """Remainder with the dividend's sign."""
    return F.transform(longs(v), lambda x: x % c)


def add(a, b) -> Column:
    return _both(a, b, lambda x, y: x + y)


def subtract(a, b) -> Column:
    return _both(a, b, lambda x, y: x - y)


def add_scaled(a, b, c: float) -> Column:
    return _both(a, b, lambda x, y: x + y * c)


def multiply(a, b) -> Column:
    return _both(a, b, lambda x, y: x * y)


def divide(a, b) -> Column:
    return _both(a, b, ieee_div)


def round_half(v) -> Column:
    """x + 0.5 cut off towards zero."""
    return F.transform(doubles(v), lambda x: F.when(x + 0.5 >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x + 0.5)).cast("double"))


def sqrt(v) -> Column:
    return F.transform(doubles(v), lambda x: F.when(x >= 0, F.sqrt(x)).otherwise(NAN))


def square(v) -> Column:
    return F.transform(doubles(v), lambda x: x * x)


def exp(v) -> Column:
    return F.transform(doubles(v), F.exp)


def log(v) -> Column:
    return F.transform(doubles(v), ieee_log)


def negate(v) -> Column:
    return F.transform(doubles(v), lambda x: -x)


def signed_power(v, p: float = 0.5) -> Column:
    return F.transform(doubles(v), lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(float(p))))


def replace(v, old: int, new: int) -> Column:
    return F.transform(longs(v), lambda x: F.when(x == old, F.lit(new).cast("bigint")).otherwise(x))


def replace_nan(v, value: float) -> Column:
    return F.transform(doubles(v), lambda x: F.nanvl(x, F.lit(float(value))))


def replace_nonfinite(v, value: float) -> Column:
    return F.transform(doubles(v), lambda x: F.when(is_finite(x), x).otherwise(F.lit(float(value))))


def drop_nonfinite(v) -> Column:
    return F.filter(doubles(v), is_finite)


def unsigned_bytes(data) -> Column:
    """A binary column as numbers 0 to 255."""
    h = F.hex(_c(data))
    return F.transform(int_range(0, F.length(_c(data))), lambda i: F.conv(F.substr(h, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("double"))


def cumsum(v) -> Column:
    """Inclusive running sums of a short vector; for long sequences see operators.ordered.running_sum."""
    grow = F.aggregate(doubles(v), F.struct(F.lit(0.0).alias("s"), _EMPTY("double").alias("a")), lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")))
    return grow["a"]


def cumdiff(v) -> Column:
    """Differences to the element before; the first stays."""
    return _let(doubles(v), lambda w: F.transform(w, lambda x, i: x - F.coalesce(F.get(w, i - 1), F.lit(0.0))))


def gather(v, positions) -> Column:
    return _let(doubles(v), lambda w: F.transform(_c(positions), lambda i: F.get(w, i.cast("int"))))


def scatter(v, positions, n: int) -> Column:
    """A vector of n with v[i] at positions[i], zero elsewhere; the last of equal positions wins."""
    v, at = doubles(v), F.reverse(_c(positions).cast("array<bigint>"))
    return F.transform(int_range(0, n), lambda j: F.coalesce(F.get(F.reverse(v), (F.array_position(at, j) - 1).cast("int")), F.lit(0.0)))


def tile_with_step(v, times: int, step: int) -> Column:
    """``times`` copies, the k-th with k * step added."""
    v = longs(v)
    return F.flatten(F.transform(int_range(0, times), lambda k: F.transform(v, lambda x: x + k * step)))


def slice_sums(v, ends) -> Column:
    """Sums of v up to each of the ends, exclusive."""
    v = doubles(v)
    return F.transform(_c(ends), lambda e: _sum(F.slice(v, 1, e.cast("int"))))


#: Fixed values of the polynomial hash.
HASH_A, HASH_B = 63689, 378551


def _times32(x: Column, y) -> Column:
    y = y if isinstance(y, Column) else F.lit(y).cast("bigint")
    high, low = F.shiftright(y, 16), y.bitwiseAND(F.lit(0xFFFF))
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    return ((x * high).bitwiseAND(F.lit(0xFFFF)) * 65536 + x * low).bitwiseAND(mask)


def poly_hash(v) -> Column:
    """Polynomial hash with 32-bit wrap-around, as a signed 32-bit number."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    zero = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(HASH_A).cast("bigint").alias("a"))
    end = F.aggregate(longs(v), zero, lambda s, x: F.struct((_times32(s["h"], s["a"]) + x.bitwiseAND(mask)).bitwiseAND(mask).alias("h"), _times32(s["a"], HASH_B).alias("a")))["h"]
    return F.when(end >= 2**31, end - 2**32).otherwise(end)


# --- predicates, counts, positions


def all_zero(v) -> Column:
    return F.forall(doubles(v), lambda x: (x == 0) & ~F.isnan(x))


def all_nonnegative(v) -> Column:
    """No element is below zero; NaN passes."""
    return F.forall(doubles(v), lambda x: F.isnan(x) | (x >= 0))


def all_finite(v) -> Column:
    return F.forall(doubles(v), is_finite)


def _count(v, p) -> Column:
    return F.size(F.filter(doubles(v), p)).cast("bigint")


def count_equal(v, value: float) -> Column:
    return _count(v, lambda x: ~F.isnan(x) & (x == value))


def count_below(v, value: float) -> Column:
    return _count(v, lambda x: x < value)


def count_above(v, value: float) -> Column:
    return _count(v, lambda x: ~F.isnan(x) & (x > value))


def count_in_range(v, low: float, high: float) -> Column:
    return _count(v, lambda x: (x >= low) & (x < high))


def count_nan(v) -> Column:
    return _count(v, F.isnan)


def count_nonfinite(v) -> Column:
    return _count(v, lambda x: ~is_finite(x))


def count_zero(v) -> Column:
    return _count(v, lambda x: ~F.isnan(x) & (x == 0))


def count_nonzero(v) -> Column:
    return _count(v, lambda x: F.isnan(x) | (x != 0))


def positions_nonzero(v) -> Column:
    return _let(doubles(v), lambda w: F.filter(int_range(0, F.size(w)), lambda i: F.isnan(F.get(w, i.cast("int"))) | (F.get(w, i.cast("int")) != 0)))


def first_index(v, value: int) -> Column:
    """Position of the first equal element, -1 without one."""
    return F.array_position(longs(v), F.lit(value).cast("bigint")) - 1


def first_nonfinite(v) -> Column:
    v = doubles(v)
    return F.array_position(F.transform(v, lambda x: ~is_finite(x)), True) - 1


# --- sums, norms, extremes


def total(v) -> Column:
    return _sum(doubles(v))


def mean(v) -> Column:
    v = doubles(v)
    return ieee_div(_sum(v), F.size(v).cast("double"))


def int_mean(v) -> Column:
    """Mean of whole numbers, cut off towards zero."""
    v = longs(v)
    s = F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return ((s - s % F.size(v)) / F.size(v)).cast("bigint")


def product(v) -> Column:
    return F.aggregate(doubles(v), F.lit(1.0), lambda a, x: a * x)


def sum_squares(v) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda a, x: a + x * x)


def norm(v, p: float = 2.0) -> Column:
    """Minkowski norm; p = 0: the length, p = -1: the greatest absolute value."""
    v = doubles(v)
    if p == 0:
        return F.size(v).cast("double")
    if p == -1:
        return F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    if p == 1:
        return F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x))
    if p == 2:
        return F.sqrt(sum_squares(v))
    return F.pow(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x), F.lit(float(p)))), F.lit(1.0 / p))


def normalize(v, p: float = 2.0, fill: float | None = None) -> Column:
    """v over its p-norm; a vector of norm zero becomes NaN, or ``fill``. p = 0 changes nothing."""
    if p == 0:
        return doubles(v)
    done = _let(norm(v, p), lambda n: F.transform(doubles(v), lambda x: ieee_div(x, n)))
    return done if fill is None else F.when(norm(v, p) == 0, F.transform(doubles(v), lambda x: F.lit(float(fill)))).otherwise(done)


def normalize_clipped(v, clip: float) -> Column:
    """Unit length, elements cut at ``clip``, unit length again if any was cut."""
    cut = lambda unit: F.transform(unit, lambda x: F.least(x, F.lit(float(clip))))
    return _let(normalize(v), lambda unit: F.when(F.exists(unit, lambda x: x > clip), normalize(cut(unit))).otherwise(unit))


def scale_by_norm_power(v, power: float, eps: float = 0.0) -> Column:
    factor = F.pow(sum_squares(v) + eps, F.lit(float(power)))
    return _let(factor, lambda f: F.transform(doubles(v), lambda x: x * f))


def entropy(v) -> Column:
    """In bits, over elements above zero."""
    return -F.aggregate(doubles(v), F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def binary_entropy(p: Column) -> Column:
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def imbalance(hist) -> Column:
    """n * sum of squares over the square of the sum: 1 for equal bins."""
    h = doubles(hist)
    return ieee_div(F.size(h) * sum_squares(h), F.pow(_sum(h), F.lit(2.0)))


def _numbers(v) -> Column:
    return F.filter(doubles(v), lambda x: ~F.isnan(x))


def minimum(v) -> Column:
    return F.array_min(_numbers(v))


def maximum(v) -> Column:
    return F.array_max(_numbers(v))


def arg_min(v) -> Column:
    """Position of the least element, the first of equals."""
    return F.array_position(doubles(v), minimum(v)) - 1


def arg_max(v) -> Column:
    return F.array_position(doubles(v), maximum(v)) - 1


def median(v) -> Column:
    s = F.sort_array(doubles(v))
    n = F.size(s)
    mid = lambda k: F.get(s, F.floor(k).cast("int"))
    return F.when(n == 0, NAN).otherwise((mid((n - 1) / 2) + mid(n / 2)) / 2)


def order_statistic(v, q: int) -> Column:
    """The value that q elements come before in order; q = 0: the least, q >= n: the greatest."""
    s = F.sort_array(doubles(v))
    return F.get(s, F.least(F.lit(q), F.size(s) - 1))


def argsort(v, ascending: bool = True) -> Column:
    """Positions in order of the elements, ties by position."""
    pairs = F.transform(doubles(v), lambda x, i: F.struct((x if ascending else -x).alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda s: s["i"])


def top_positions(v, k: int, largest: bool = True) -> Column:
    return F.slice(argsort(v, not largest), 1, k)


def histogram_clipped(v, low: float, high: float, bins: int) -> Column:
    """Counts in equal bins over [low, high), values outside in the outer ones; NaN doesn't count."""
    at = F.transform(_numbers(v), lambda x: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.greatest(F.lit(low - 1.0), F.least(F.lit(high + 1.0), x)) - low) * bins / (high - low)).cast("int"))))
    return F.transform(int_range(0, bins), lambda b: F.size(F.filter(at, lambda x: x == b)).cast("bigint"))


# --- distances


def l2_squared(a, b) -> Column:
    return _sum(_both(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a, b) -> Column:
    return F.sqrt(l2_squared(a, b))


def l1(a, b) -> Column:
    return _sum(_both(a, b, lambda x, y: F.abs(x - y)))


def dot(a, b) -> Column:
    return _sum(_both(a, b, lambda x, y: x * y))


def chi2(a, b) -> Column:
    """Sum of (x - y)^2 / (x + y) where x + y isn't zero."""
    return _sum(_both(a, b, lambda x, y: F.when(x + y != 0, (x - y) * (x - y) / F.nullif(x + y, F.lit(0.0))).otherwise(0.0)))


def chi2_abs(a, b) -> Column:
    """The same with absolute values in the denominator."""
    return _sum(_both(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) != 0, (x - y) * (x - y) / F.nullif(F.abs(x) + F.abs(y), F.lit(0.0))).otherwise(0.0)))


def intersection(a, b) -> Column:
    return _sum(_both(a, b, lambda x, y: F.least(x, y)))


def differing(a, b) -> Column:
    """How many elements differ."""
    return F.aggregate(_both(a, b, lambda x, y: (x != y).cast("bigint"), longs), F.lit(0).cast("bigint"), lambda s, x: s + x)


DISTANCES = {"l1": l1, "l2": l2_squared, "chi2": chi2, "chi2_abs": chi2_abs, "intersection": intersection, "dot": dot}


def distance(kind: str, a, b) -> Column:
    return DISTANCES[kind](a, b)


# --- binary codes in 64-bit words


def sign_words(v, thresholds=None) -> Column:
    """Bits v > threshold (0 without thresholds), the first in the lowest place, in words of 64."""
    v = doubles(v)
    bits = F.transform(v, lambda x: (x > 0).cast("bigint")) if thresholds is None else _both(v, thresholds, lambda x, t: (x > t).cast("bigint").cast("double"))
    words = F.ceil(F.size(v) / 64).cast("int")
    return F.transform(
        int_range(0, words),
        lambda w: F.aggregate(F.transform(F.slice(bits, (w * 64 + 1).cast("int"), F.lit(64)), lambda x, i: F.call_function("shiftleft", x.cast("bigint"), i)), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x)),
    )


def hamming(a, b) -> Column:
    """Differing bits of two codes of the same number of words."""
    return F.aggregate(_both(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint"), longs), F.lit(0).cast("bigint"), lambda s, x: s + x)


def unpack_bits(data) -> Column:
    """Bits of a binary column, the lowest of each byte first."""
    return F.flatten(F.transform(unsigned_bytes(data), lambda x: F.transform(int_range(0, 8), lambda i: F.call_function("shiftright", x.cast("int"), i.cast("int")).bitwiseAND(F.lit(1)).cast("bigint"))))


# --- sparse vectors: array<struct<idx, val>> in order of idx


def to_sparse(v) -> Column:
    return F.filter(F.transform(doubles(v), lambda x, i: F.struct(i.cast("bigint").alias("idx"), x.alias("val"))), lambda e: e["val"] != 0)


def to_dense(s, n: int) -> Column:
    """Of length n; negative positions are passed over."""
    m = F.map_from_entries(F.filter(_c(s), lambda e: e["idx"] >= 0))
    return F.transform(int_range(0, n), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))


def sparse_dot(a, b) -> Column:
    m = F.map_from_entries(_c(b))
    return F.aggregate(_c(a), F.lit(0.0), lambda s, e: s + e["val"] * F.coalesce(F.element_at(m, e["idx"]), F.lit(0.0)))


# --- embeddings


def poly2(v) -> Column:
    """x_i^2 and sqrt(2) x_i x_j for i < j, by rows."""
    row = lambda w: lambda x, i: F.transform(F.slice(w, i + 1, F.size(w)), lambda y, j: F.when(j == 0, x * x).otherwise(x * y * (2**0.5)))
    return _let(doubles(v), lambda w: F.flatten(F.transform(w, row(w))))


def poly3(v) -> Column:
    """Cubic monomials: x_i^3, sqrt(3) x_i^2 x_j for i <> j, sqrt(6) x_i x_j x_k for i < j < k, in this order."""

    def all_(w: Column) -> Column:
        cubes = F.transform(w, lambda x: x * x * x)
        mixed = F.flatten(F.transform(w, lambda x, i: F.transform(F.concat(F.slice(w, 1, i), F.slice(w, i + 2, F.size(w))), lambda y: x * x * y * (3**0.5))))
        three = F.flatten(F.flatten(F.transform(w, lambda x, i: F.transform(F.slice(w, i + 2, F.size(w)), lambda y, j: F.transform(F.slice(w, i + j + 3, F.size(w)), lambda z: x * y * z * (6**0.5))))))
        return F.concat(cubes, mixed, three)

    return _let(doubles(v), all_)


def angular(v, theta: float | Column, coefficients: list[float]) -> Column:
    """a_0 v, then a_j cos(j theta) v, then a_j sin(j theta) v for j = 1 on."""
    theta = theta if isinstance(theta, Column) else F.lit(float(theta))
    parts = [scale(v, coefficients[0])]
    parts += [scale(v, F.cos(theta * j) * a) for j, a in enumerate(coefficients) if j]
    parts += [scale(v, F.sin(theta * j) * a) for j, a in enumerate(coefficients) if j]
    return F.concat(*parts)
