"""Column functions on literals: empty, single, zero, NaN, infinite, negative and tied elements."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import vectors as V

NAN, INF = math.nan, math.inf


@pytest.fixture(scope="module")
def value(spark):
    def get(column, **arrays):
        df = spark.range(1)
        for name, x in arrays.items():
            df = df.withColumn(name, F.array(*[F.lit(y) for y in x]).cast("array<double>"))
        return df.select(column.alias("x")).first()["x"]

    return get


def same(a, b):
    return a == pytest.approx(b, nan_ok=True)


CASES = [
    (lambda: V.add_scalar("v", 1), [1.0, NAN, -INF], [2.0, NAN, -INF]),
    (lambda: V.divide_scalar("v", 0), [1.0, -1.0, 0.0, NAN], [INF, -INF, NAN, NAN]),
    (lambda: V.divided_scalar("v", 1), [0.0, 2.0], [INF, 0.5]),
    (lambda: V.int_mod("v", 3), [-7, 7, -3], [-1, 1, 0]),
    (lambda: V.round_half("v"), [-1.5, -0.7, 0.5, 2.4, 2.5], [-1, 0, 1, 2, 3]),
    (lambda: V.sqrt("v"), [4.0, -1.0, 0.0], [2.0, NAN, 0.0]),
    (lambda: V.log("v"), [1.0, 0.0, -1.0], [0.0, -INF, NAN]),
    (lambda: V.signed_power("v"), [-4.0, 0.0, 9.0], [-2.0, 0.0, 3.0]),
    (lambda: V.replace("v", 2, 9), [2, 1, 2], [9, 1, 9]),
    (lambda: V.replace_nan("v", 2), [NAN, 1.0, INF], [2.0, 1.0, INF]),
    (lambda: V.replace_nonfinite("v", 0), [NAN, 1.0, INF], [0.0, 1.0, 0.0]),
    (lambda: V.drop_nonfinite("v"), [NAN, 1.0, -INF], [1.0]),
    (lambda: V.cumsum("v"), [1.0, 2.0, 3.0], [1, 3, 6]),
    (lambda: V.cumsum("v"), [], []),
    (lambda: V.cumdiff("v"), [5.0, 7.0, 4.0], [5, 2, -3]),
    (lambda: V.tile_with_step("v", 2, 10), [1, 2], [1, 2, 11, 12]),
    (lambda: V.int_range(3, 3), [], []),
    (lambda: V.int_range(1, 4), [], [1, 2, 3]),
    (lambda: V.resize("v", 3, 7), [1.0], [1, 7, 7]),
    (lambda: V.resize("v", 1), [1.0, 2.0], [1]),
    (lambda: V.poly_hash("v"), [1, 2, 3], 3731150924 - 2**32),
    (lambda: V.poly_hash("v"), [], 0),
    (lambda: V.all_zero("v"), [0.0, 0.0], True),
    (lambda: V.all_zero("v"), [0.0, NAN], False),
    (lambda: V.all_nonnegative("v"), [0.0, NAN], True),
    (lambda: V.all_finite("v"), [1.0, INF], False),
    (lambda: V.count_equal("v", 1), [1.0, NAN, 1.0], 2),
    (lambda: V.count_above("v", 1), [2.0, NAN, INF], 2),
    (lambda: V.count_below("v", 1), [0.0, NAN, -INF], 2),
    (lambda: V.count_in_range("v", 0, 1), [0.0, 1.0, 0.5], 2),
    (lambda: V.count_nan("v"), [NAN, INF], 1),
    (lambda: V.count_nonfinite("v"), [NAN, INF, 0.0], 2),
    (lambda: V.positions_nonzero("v"), [0.0, 2.0, NAN], [1, 2]),
    (lambda: V.first_index("v", 5), [1, 5, 5], 1),
    (lambda: V.first_index("v", 6), [1, 5], -1),
    (lambda: V.first_nonfinite("v"), [1.0, INF], 1),
    (lambda: V.mean("v"), [], NAN),
    (lambda: V.int_mean("v"), [-3, -4], -3),
    (lambda: V.product("v"), [], 1),
    (lambda: V.norm("v", 0), [1.0, 2.0], 2),
    (lambda: V.norm("v", -1), [1.0, -3.0], 3),
    (lambda: V.norm("v", 3), [-1.0, 2.0], 9 ** (1 / 3)),
    (lambda: V.normalize("v"), [0.0, 0.0], [NAN, NAN]),
    (lambda: V.normalize("v", fill=0), [0.0, 0.0], [0, 0]),
    (lambda: V.normalize("v", 0), [3.0], [3]),
    (lambda: V.entropy("v"), [0.5, 0.5, 0.0], 1),
    (lambda: V.imbalance("v"), [3.0, 3.0], 1),
    (lambda: V.minimum("v"), [NAN, 2.0, 1.0], 1),
    (lambda: V.maximum("v"), [NAN, 2.0, 1.0], 2),
    (lambda: V.arg_min("v"), [2.0, 1.0, 1.0], 1),
    (lambda: V.arg_max("v"), [2.0, 2.0, 1.0], 0),
    (lambda: V.median("v"), [3.0, 1.0, 2.0], 2),
    (lambda: V.median("v"), [4.0, 1.0, 2.0, 3.0], 2.5),
    (lambda: V.median("v"), [], NAN),
    (lambda: V.order_statistic("v", 0), [3.0, 1.0], 1),
    (lambda: V.order_statistic("v", 9), [3.0, 1.0], 3),
    (lambda: V.argsort("v"), [2.0, 1.0, 2.0, 1.0], [1, 3, 0, 2]),
    (lambda: V.top_positions("v", 2), [1.0, 3.0, 3.0], [1, 2]),
    (lambda: V.histogram_clipped("v", 0, 1, 2), [-5.0, 0.2, 0.9, 7.0, NAN, INF, -INF], [3, 3]),
    (lambda: V.to_dense(V.to_sparse("v"), 4), [0.0, 5.0, 0.0], [0, 5, 0, 0]),
    (lambda: V.sparse_dot(V.to_sparse("v"), V.to_sparse("v")), [0.0, 5.0, 2.0], 29),
    (lambda: V.sign_words("v"), [1.0, -1.0, 1.0], [5]),
    (lambda: V.sign_words("v"), [-1.0] * 64 + [2.0], [0, 1]),
    (lambda: V.poly2("v"), [1.0, 2.0, 3.0], [1, 2 * 2**0.5, 3 * 2**0.5, 4, 6 * 2**0.5, 9]),
    (lambda: V.angular("v", 0.5, [2.0, 3.0]), [1.0], [2, 3 * math.cos(0.5), 3 * math.sin(0.5)]),
    (lambda: V.chi2("v", "v"), [0.0, 1.0], 0),
    (lambda: V.hadamard_row(F.lit(3), 4), [], [1, -1, -1, 1]),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_on_literals(value, i):
    f, v, want = CASES[i]
    assert same(value(f(), v=v), want)


def test_binary_entropy_and_bytes(spark, value):
    assert value(V.binary_entropy(F.lit(0.0))) == 0 and value(V.binary_entropy(F.lit(0.5))) == 1
    assert value(V.unsigned_bytes(F.lit(bytearray([0, 200])))) == [0.0, 200.0]
    assert value(V.unpack_bits(F.lit(bytearray([5])))) == [1, 0, 1, 0, 0, 0, 0, 0]


def test_scatter_takes_the_last(value):
    assert value(V.scatter("v", F.array(F.lit(0), F.lit(0)), 2), v=[1.0, 2.0]) == [2.0, 0.0]


@pytest.mark.parametrize("f", [V.add, V.dot, V.l1, V.l2_squared, V.differing, V.hamming])
def test_lengths_must_agree(value, f):
    with pytest.raises(Exception, match="vectors differ in length"):
        value(f("v", "w"), v=[1.0], w=[1.0, 2.0])


def test_hadamard_is_orthogonal(spark):
    rows = spark.range(8).select("id", V.hadamard_row(F.col("id"), 8).alias("v")).orderBy("id").collect()
    h = np.array([r["v"] for r in rows])
    assert np.array_equal(h @ h.T, 8 * np.eye(8))
    with pytest.raises(ValueError, match="power of two"):
        V.hadamard_row(F.lit(0), 6)
