"""One query for each operator over the driver's tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import clustering, descriptors, hamming, inverted, linalg, lsh, mixture, neighbours, ordered, tables
from vectide.plans import rounds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: id, v (doubles), r (v reversed), iv (whole numbers), label.
E_SQL = "(SELECT vec_id id, embedding::DOUBLE[] v, list_reverse(embedding::DOUBLE[]) r, list_transform(embedding::DOUBLE[], lambda x: floor(x * 10)::BIGINT) iv, label FROM embeddings)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def E(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.doubles("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), v.alias("v"), F.reverse(v).alias("r"), F.transform(v, lambda x: F.floor(x * 10)).alias("iv"), "label")


def rounded(x: Column, digits: int = 6) -> Column:
    x = F.round(x.cast("double"), digits)
    return F.when(x == 0, 0.0).otherwise(x)


def quickly_rounded(x: Column, digits: int = 6) -> Column:
    """The same by way of whole numbers, as in SQL, where those are exact; for results of very many rows."""
    size = F.abs(x) * 10.0**digits
    r = F.when(size < 2.0**52, F.signum(x) * (F.floor(size + 0.5) / 10.0**digits)).otherwise(F.round(x, digits))
    return F.when(r == 0, 0.0).otherwise(r)


def rounded_sql(x: str, digits: int = 6) -> str:
    return f"CASE WHEN round(({x})::DOUBLE, {digits}) = 0 THEN 0.0::DOUBLE ELSE round(({x})::DOUBLE, {digits}) END"


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def vector_query(name: str, f: Callable[[], Column], sql: str) -> None:
    """id, pos, x of a vector expression over E."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E(spark, sf_dir).select("id", F.posexplode(f()).alias("pos", "x")).select("id", F.col("pos").cast("bigint").alias("pos"), rounded(F.col("x")).alias("x"))

    add(name, query, f"SELECT id, pos, {rounded_sql('x')} x FROM (SELECT id, generate_subscripts(w, 1)::BIGINT - 1 pos, unnest(w)::DOUBLE x FROM (SELECT id, {sql} w FROM {E_SQL}))")


def scalar_query(name: str, f: Callable[[], Column], sql: str, whole: bool = False) -> None:
    """id, x of a scalar expression over E."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E(spark, sf_dir).select("id", (f().cast("bigint") if whole else rounded(f())).alias("x"))

    add(name, query, f"SELECT id, {f'({sql})::BIGINT' if whole else rounded_sql('s')} x FROM (SELECT *, {sql} s FROM {E_SQL})")


def each(body: str, over: str = "v") -> str:
    return f"list_transform({over}, lambda x: {body})"


def paired(body: str) -> str:
    return f"list_transform(list_zip(v, r), lambda z: {body.replace('$a', 'z[1]').replace('$b', 'z[2]')})"


# constructors
vector_query("constant_fill", lambda: V.constant(F.size("v"), 2.5), "list_transform(v, lambda x: 2.5)")
vector_query("int_range", lambda: V.int_range(F.col("id") % 7, F.col("id") % 7 + 5), "range(id % 7, id % 7 + 5)")
vector_query("resize_vector", lambda: V.resize("v", 70), "list_concat(v, [0.0, 0, 0, 0, 0, 0])")
vector_query("reverse_vector", lambda: V.reverse("v"), "list_reverse(v)")
add(
    "hadamard_matrix",
    lambda s, d: s.range(64).select("id", F.posexplode(V.hadamard_row(F.col("id"), 64)).alias("pos", "x")).select("id", F.col("pos").cast("bigint").alias("pos"), "x"),
    "SELECT i id, j pos, CASE WHEN bit_count(i & j) % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE x FROM range(64) a(i), range(64) b(j)",
)
add("random_sample", lambda s, d: tables.sample_rows(E(s, d), 50, "id", 3).select("id"))
add("random_permutation", lambda s, d: tables.random_permutation(E(s, d).select("id"), "id", 3))
add("random_uniform_vectors", lambda s, d: tables.random_vectors(s, 200, 16, 1))
add("random_normal_vectors", lambda s, d: tables.random_vectors(s, 200, 16, 1, normal=True))
add("random_orthogonal_basis", lambda s, d: s.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(linalg.random_orthogonal(16, 1))], "id long, v array<double>"))

# elementwise
vector_query("add_scalar", lambda: V.add_scalar("v", 1.5), each("x + 1.5"))
vector_query("scale_vector", lambda: V.scale("v", 3.0), each("x * 3.0"))
vector_query("divide_by_scalar", lambda: V.divide_scalar("v", 4.0), each("x / 4.0"))
vector_query("scalar_divided", lambda: V.divided_scalar(V.add_scalar("v", 2.0), 3.0), each("3.0 / (x + 2.0)"))
vector_query("int_modulo", lambda: V.int_mod("iv", 3), each("x % 3", "iv"))
vector_query("add_vectors", lambda: V.add("v", "r"), paired("$a + $b"))
vector_query("subtract_vectors", lambda: V.subtract("v", "r"), paired("$a - $b"))
vector_query("reverse_subtract", lambda: V.subtract("r", "v"), paired("$b - $a"))
vector_query("add_scaled_vector", lambda: V.add_scaled("v", "r", 2.0), paired("$a + $b * 2.0"))
vector_query("multiply_vectors", lambda: V.multiply("v", "r"), paired("$a * $b"))
vector_query("divide_vectors", lambda: V.divide("v", V.add_scalar("r", 2.0)), paired("$a / ($b + 2.0)"))
vector_query("round_half", lambda: V.round_half(V.scale("v", 10.0)), each("trunc(x * 10.0 + 0.5)"))
vector_query("sqrt_vector", lambda: V.sqrt(V.square("v")), each("sqrt(x * x)"))
vector_query("square_vector", lambda: V.square("v"), each("x * x"))
vector_query("exp_vector", lambda: V.exp("v"), each("exp(x)"))
vector_query("log_vector", lambda: V.log(V.add_scalar("v", 2.0)), each("ln(x + 2.0)"))
vector_query("negate_vector", lambda: V.negate("v"), each("-x"))
vector_query("signed_sqrt", lambda: V.signed_power("v"), each("sign(x) * pow(abs(x), 0.5)"))
vector_query("signed_power", lambda: V.signed_power("v", 0.3), each("sign(x) * pow(abs(x), 0.3)"))
vector_query("replace_value", lambda: V.replace("iv", 0, 100), each("CASE WHEN x = 0 THEN 100 ELSE x END", "iv"))
vector_query("replace_nan", lambda: V.replace_nan(F.transform("v", lambda x: F.when(x > 0.1, V.NAN).otherwise(x)), 2.0), each("CASE WHEN x > 0.1 THEN 2.0 ELSE x END"))
vector_query("replace_nonfinite", lambda: V.replace_nonfinite(F.transform("v", lambda x: F.when(x > 0.1, V.INF).otherwise(x)), -1.0), each("CASE WHEN x > 0.1 THEN -1.0 ELSE x END"))
vector_query("drop_nonfinite", lambda: V.drop_nonfinite(F.transform("v", lambda x: F.when(x > 0.1, V.NAN).otherwise(x))), "list_filter(v, lambda x: NOT (x > 0.1))")
vector_query("int_to_float", lambda: V.doubles("iv"), each("x::DOUBLE", "iv"))
vector_query("cumulative_sum", lambda: V.cumsum("v"), "list_transform(range(1, len(v) + 1), lambda i: list_sum(v[1:i]))")
vector_query("cumulative_difference", lambda: V.cumdiff("v"), "list_transform(range(1, len(v) + 1), lambda i: v[i] - CASE WHEN i > 1 THEN v[i - 1] ELSE 0 END)")
vector_query("gather_elements", lambda: V.gather("v", F.transform(V.int_range(0, 10), lambda i: (i * 7) % 64)), "list_transform(range(10), lambda i: v[(i * 7) % 64 + 1])")
vector_query("scatter_elements", lambda: V.scatter(F.slice("v", 1, 8), F.transform(V.int_range(0, 8), lambda i: (i * 3) % 10), 10), "list_transform([0, 7, 4, 1, -1, 5, 2, -1, 6, 3], lambda i: CASE WHEN i < 0 THEN 0.0 ELSE v[i + 1] END)")
vector_query("tile_with_step", lambda: V.tile_with_step(F.slice("iv", 1, 4), 3, 100), "list_concat(list_concat(iv[1:4], list_transform(iv[1:4], lambda x: x + 100)), list_transform(iv[1:4], lambda x: x + 200))")
vector_query("slice_sums", lambda: V.slice_sums("v", F.array(*map(F.lit, (3, 10, 64)))), "[list_sum(v[1:3]), list_sum(v[1:10]), list_sum(v[1:64])]")
add(
    "polynomial_hash",
    lambda s, d: E(s, d).select("id", V.poly_hash(F.slice("iv", 1, 8)).alias("x")),
    f"""WITH RECURSIVE h(id, i, iv, h, a) AS (SELECT id, 0, iv, 0::HUGEINT, 63689::HUGEINT FROM {E_SQL}
    UNION ALL SELECT id, i + 1, iv, (h * a + CASE WHEN iv[i + 1] < 0 THEN iv[i + 1] + 4294967296 ELSE iv[i + 1] END) % 4294967296, (a * 378551) % 4294967296 FROM h WHERE i < 8)
    SELECT id, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::BIGINT x FROM h WHERE i = 8""",
)

# predicates and counts
scalar_query("all_zero", lambda: V.all_zero("v").cast("int"), "CASE WHEN list_aggregate(list_transform(v, lambda x: x = 0), 'bool_and') THEN 1 ELSE 0 END", whole=True)
scalar_query("all_nonnegative", lambda: V.all_nonnegative(V.add_scalar("v", 0.3)).cast("int"), "CASE WHEN list_min(v) + 0.3 >= 0 THEN 1 ELSE 0 END", whole=True)
scalar_query("all_finite", lambda: V.all_finite("v").cast("int"), "1", whole=True)
scalar_query("count_equal", lambda: V.count_equal("iv", 0), "len(list_filter(iv, lambda x: x = 0))", whole=True)
scalar_query("count_below", lambda: V.count_below("v", 0.05), "len(list_filter(v, lambda x: x < 0.05))", whole=True)
scalar_query("count_above", lambda: V.count_above("v", 0.05), "len(list_filter(v, lambda x: x > 0.05))", whole=True)
scalar_query("count_in_range", lambda: V.count_in_range("v", -0.05, 0.05), "len(list_filter(v, lambda x: x >= -0.05 AND x < 0.05))", whole=True)
scalar_query("count_nan", lambda: V.count_nan(F.transform("v", lambda x: F.when(x > 0.1, V.NAN).otherwise(x))), "len(list_filter(v, lambda x: x > 0.1))", whole=True)
scalar_query("count_nonfinite", lambda: V.count_nonfinite(F.transform("v", lambda x: F.when(x > 0.1, -V.INF).otherwise(x))), "len(list_filter(v, lambda x: x > 0.1))", whole=True)
scalar_query("count_zero", lambda: V.count_zero("iv"), "len(list_filter(iv, lambda x: x = 0))", whole=True)
scalar_query("count_nonzero", lambda: V.count_nonzero("iv"), "len(list_filter(iv, lambda x: x <> 0))", whole=True)
vector_query("nonzero_positions", lambda: V.positions_nonzero("iv"), "list_filter(range(len(iv)), lambda i: iv[i + 1] <> 0)")
scalar_query("first_index", lambda: V.first_index("iv", 1), "coalesce(list_position(iv, 1), 0) - 1", whole=True)
scalar_query("first_nonfinite", lambda: V.first_nonfinite(F.transform("v", lambda x: F.when(x > 0.1, V.NAN).otherwise(x))), "coalesce(list_position(list_transform(v, lambda x: x > 0.1), true), 0) - 1", whole=True)
add(
    "find_labels",
    lambda s, d: ordered.find_labels(s.range(0, 15).withColumnRenamed("id", "want"), E(s, d).select("id", "label"), "want", "label", "id"),
    "SELECT w want, coalesce(min(vec_id), -1)::BIGINT \"position\" FROM range(15) t(w) LEFT JOIN embeddings ON label = w GROUP BY w",
)
add("drop_zero_vectors", lambda s, d: tables.nonzero_vectors(E(s, d).withColumn("c", F.slice("iv", 1, 2)), "c").select("id"), f"SELECT id FROM {E_SQL} WHERE NOT (iv[1] = 0 AND iv[2] = 0)")

# sums, norms, extremes
scalar_query("vector_sum", lambda: V.total("v"), "list_sum(v)")
scalar_query("vector_mean", lambda: V.mean("v"), "list_avg(v)")
scalar_query("int_mean", lambda: V.int_mean("iv"), "trunc(list_sum(iv) / len(iv))", whole=True)
scalar_query("vector_product", lambda: V.product(V.add_scalar("v", 1.0)), "list_product(list_transform(v, lambda x: x + 1.0))")
scalar_query("sum_of_squares", lambda: V.sum_squares("v"), "list_sum(list_transform(v, lambda x: x * x))")
scalar_query("norm_p0", lambda: V.norm("v", 0), "len(v)")
scalar_query("norm_p1", lambda: V.norm("v", 1), "list_sum(list_transform(v, lambda x: abs(x)))")
scalar_query("norm_p2", lambda: V.norm("v", 2), "sqrt(list_sum(list_transform(v, lambda x: x * x)))")
scalar_query("norm_p3", lambda: V.norm("v", 3), "pow(list_sum(list_transform(v, lambda x: pow(abs(x), 3.0))), 1.0 / 3)")
scalar_query("norm_max", lambda: V.norm("v", -1), "list_max(list_transform(v, lambda x: abs(x)))")
vector_query("normalize_l1", lambda: V.normalize("v", 1), "list_transform(v, lambda x: x / list_sum(list_transform(v, lambda y: abs(y))))")
vector_query("normalize_l2", lambda: V.normalize("iv", 2, fill=0.0), "list_transform(iv, lambda x: x / sqrt(list_sum(list_transform(iv, lambda y: y * y))))")
vector_query(
    "normalize_two_stage",
    lambda: V.normalize_clipped("v", 0.2),
    """(CASE WHEN list_max(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))) > 0.2
    THEN list_transform(v, lambda x: least(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 0.2) / sqrt(list_sum(list_transform(list_transform(v, lambda y: least(y / sqrt(list_sum(list_transform(v, lambda q: q * q))), 0.2)), lambda t: t * t))))
    ELSE list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) END)""",
)
vector_query("root_normalize", lambda: V.normalize(V.signed_power("v")), "list_transform(v, lambda x: sign(x) * sqrt(abs(x)) / sqrt(list_sum(list_transform(v, lambda y: abs(y)))))")
vector_query("scale_by_norm_power", lambda: V.scale_by_norm_power("v", 0.25, 0.5), "list_transform(v, lambda x: x * pow(list_sum(list_transform(v, lambda y: y * y)) + 0.5, 0.25))")
scalar_query("entropy", lambda: V.entropy(F.transform("v", F.abs)), "-list_sum(list_transform(v, lambda x: CASE WHEN abs(x) > 0 THEN abs(x) * log2(abs(x)) ELSE 0 END))")
scalar_query("binary_entropy", lambda: V.binary_entropy(F.abs(F.get("v", 0))), "CASE WHEN abs(v[1]) <= 0 OR abs(v[1]) >= 1 THEN 0 ELSE -(abs(v[1]) * log2(abs(v[1])) + (1 - abs(v[1])) * log2(1 - abs(v[1]))) END")
scalar_query("imbalance_of_counts", lambda: V.imbalance(F.transform("v", F.abs)), "len(v) * list_sum(list_transform(v, lambda x: x * x)) / pow(list_sum(list_transform(v, lambda x: abs(x))), 2)")
scalar_query("vector_min", lambda: V.minimum("v"), "list_min(v)")
scalar_query("vector_max", lambda: V.maximum("v"), "list_max(v)")
scalar_query("arg_min", lambda: V.arg_min("iv"), "list_position(iv, list_min(iv)) - 1", whole=True)
scalar_query("arg_max", lambda: V.arg_max("iv"), "list_position(iv, list_max(iv)) - 1", whole=True)
scalar_query("median", lambda: V.median("v"), "list_median(v)")
scalar_query("order_statistic", lambda: V.order_statistic("v", 10), "list_sort(v)[11]")
vector_query("vector_histogram", lambda: V.histogram_clipped("v", -0.2, 0.2, 8), "list_transform(range(8), lambda b: len(list_filter(v, lambda x: greatest(0, least(7, floor((x - -0.2) * 8 / (0.2 - -0.2)))) = b)))")

# histograms and scatter sums over rows
add("histogram_strict", lambda s, d: tables.histogram(E(s, d), F.col("label"), 10), "SELECT b::BIGINT bin, count(label)::BIGINT n FROM range(10) t(b) LEFT JOIN embeddings ON label = b GROUP BY b")
add(
    "histogram_clipped",
    lambda s, d: tables.histogram(table(s, d, "lineitem"), F.col("l_quantity"), 40, strict=False),
    "WITH h AS (SELECT greatest(0, least(39, l_quantity::BIGINT)) bin FROM lineitem) SELECT b::BIGINT bin, count(bin)::BIGINT n FROM range(40) t(b) LEFT JOIN h ON bin = b GROUP BY b".replace("l_quantity::BIGINT", "trunc(l_quantity)::BIGINT"),
)
add(
    "histogram_of_range",
    lambda s, d: tables.histogram_range(table(s, d, "lineitem"), F.col("l_extendedprice"), 1000.0, 90000.0, 32),
    "WITH h AS (SELECT greatest(0, least(31, floor((l_extendedprice - 1000.0) * 32 / 89000.0)))::BIGINT bin FROM lineitem) SELECT b::BIGINT bin, count(bin)::BIGINT n FROM range(32) t(b) LEFT JOIN h ON bin = b GROUP BY b",
)
add("joint_histogram", lambda s, d: tables.joint_histogram(table(s, d, "lineitem"), "l_returnflag", "l_linestatus"), "SELECT l_returnflag, l_linestatus, count(*)::BIGINT n FROM lineitem GROUP BY ALL")
add(
    "imbalance_factor",
    lambda s, d: tables.imbalance(table(s, d, "lineitem"), "l_suppkey").select(rounded(F.col("factor")).alias("factor")),
    f"SELECT {rounded_sql('count(*) * sum(n * n) / pow(sum(n), 2)')} factor FROM (SELECT count(*)::DOUBLE n FROM lineitem GROUP BY l_suppkey)",
)
add(
    "splat_add",
    lambda s, d: tables.splat_add(table(s, d, "lineitem"), "l_partkey", "l_quantity").select("l_partkey", rounded(F.col("total"), 4).alias("total")),
    f"SELECT l_partkey, {rounded_sql('sum(l_quantity)', 4)} total FROM lineitem GROUP BY l_partkey",
)
add(
    "gather_add",
    lambda s, d: tables.gather_add(table(s, d, "supplier").select("s_suppkey", "s_nationkey", F.lit(100.0).alias("x")), table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.length("n_name").cast("double").alias("y")), "s_nationkey", "k", "y", "x"),
    "SELECT s_suppkey, s_nationkey, 100.0::DOUBLE + coalesce(length(n_name), 0) x FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
)
add(
    "splat_separable",
    lambda s, d: tables.splat_separable(E(s, d), "v", "label", s.range(64).select(F.col("id").alias("pos"), (F.col("id") % 5).alias("col"))).select("row", "col", rounded(F.col("total")).alias("total")),
    f"SELECT label \"row\", (pos % 5)::BIGINT col, {rounded_sql('sum(x)')} total FROM (SELECT label, generate_subscripts(v, 1) - 1 pos, unnest(v) x FROM {E_SQL}) GROUP BY label, pos % 5",
)
add(
    "sum_by_assignment",
    lambda s, d: tables.sum_by_assignment(E(s, d).withColumn("a", F.col("label") - 2), "v", "a").select("a", "pos", rounded(F.col("total")).alias("total")),
    f"SELECT a, pos::BIGINT pos, {rounded_sql('sum(x)')} total FROM (SELECT label - 2 a, generate_subscripts(v, 1) - 1 pos, unnest(v) x FROM {E_SQL}) WHERE a >= 0 GROUP BY a, pos",
)
add(
    "column_sums",
    lambda s, d: tables.column_sums(E(s, d), "v").select("pos", rounded(F.col("total")).alias("total")),
    f"SELECT pos::BIGINT pos, {rounded_sql('sum(x)')} total FROM (SELECT generate_subscripts(v, 1) - 1 pos, unnest(v) x FROM {E_SQL}) GROUP BY pos",
)

# distances of two vectors
for kind, body in {"l2_squared": "($a - $b) * ($a - $b)", "l1": "abs($a - $b)", "dot": "$a * $b", "intersection": "least($a, $b)"}.items():
    scalar_query(f"distance_{kind}", lambda f=getattr(V, kind): f("v", "r"), f"list_sum({paired(body)})")
scalar_query("distance_l2", lambda: V.l2("v", "r"), f"sqrt(list_sum({paired('($a - $b) * ($a - $b)')}))")
scalar_query("distance_chi2", lambda: V.chi2(F.transform("v", F.abs), F.transform("r", F.abs)), f"list_sum({paired('CASE WHEN abs($a) + abs($b) <> 0 THEN pow(abs($a) - abs($b), 2) / (abs($a) + abs($b)) ELSE 0 END')})")
scalar_query("distance_chi2_abs", lambda: V.chi2_abs("v", "r"), f"list_sum({paired('CASE WHEN abs($a) + abs($b) <> 0 THEN pow($a - $b, 2) / (abs($a) + abs($b)) ELSE 0 END')})")
scalar_query("distance_differing", lambda: V.differing("iv", F.reverse("iv")), "list_sum(list_transform(list_zip(iv, list_reverse(iv)), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))", whole=True)

# nearest neighbours
_PAIRS = {
    "l2": "list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
    "l1": "list_sum(list_transform(list_zip(q.v, b.v), lambda z: abs(z[1] - z[2])))",
    "chi2_abs": "list_sum(list_transform(list_zip(q.v, b.v), lambda z: CASE WHEN abs(z[1]) + abs(z[2]) <> 0 THEN pow(z[1] - z[2], 2) / (abs(z[1]) + abs(z[2])) ELSE 0 END))",
    "intersection": "list_sum(list_transform(list_zip(q.v, b.v), lambda z: least(z[1], z[2])))",
    "dot": "list_sum(list_transform(list_zip(q.v, b.v), lambda z: z[1] * z[2]))",
}
# a search takes every row whose id is divisible by 50 as a query, against all rows
_Q, _Q_SQL = "id % 50 = 0", "q.id % 50 = 0"


def _knn_sql(dis: str, k: int, where: str = _Q_SQL) -> str:
    return f"SELECT qid, \"rank\", bid, {rounded_sql('dis')} dis FROM (SELECT q.id qid, b.id bid, {dis} dis, row_number() OVER (PARTITION BY q.id ORDER BY {dis}, b.id)::BIGINT \"rank\" FROM {E_SQL} q, {E_SQL} b WHERE {where}) WHERE \"rank\" <= {k}"


def _dis(df: DataFrame, name: str = "dis") -> DataFrame:
    return df.withColumn(name, rounded(F.col(name)))


for kind in _PAIRS:
    add(f"knn_{kind}", lambda s, d, kind=kind: _dis(neighbours.knn(E(s, d).where(_Q), E(s, d), 10, kind)), _knn_sql(_PAIRS[kind], 10))
add("knn_all", lambda s, d: _dis(neighbours.knn(E(s, d), E(s, d), 10)), _knn_sql(_PAIRS["l2"], 10, "true"))
add("knn_weighted", lambda s, d: _dis(neighbours.knn(E(s, d).where(_Q), E(s, d).withColumn("w", F.lit(1.0) + F.col("label")), 5, weights="w")), _knn_sql(f"{_PAIRS['l2']} * (1.0 + b.label)", 5))
add("nearest_assignment", lambda s, d: _dis(neighbours.nearest(E(s, d), E(s, d).where("id < 20"))), f"SELECT qid, bid, dis FROM ({_knn_sql(_PAIRS['l2'], 1, 'b.id < 20')})")
add("nearest_total", lambda s, d: neighbours.nearest(E(s, d), E(s, d).where("id < 20")).agg(rounded(F.sum("dis"), 4).alias("total")), f"SELECT {rounded_sql('sum(dis)', 4)} total FROM (SELECT q.id, min({_PAIRS['l2']}) dis FROM {E_SQL} q, {E_SQL} b WHERE b.id < 20 GROUP BY q.id)")
add("cross_distances", lambda s, d: _dis(neighbours.cross_distances(E(s, d).where(_Q), E(s, d))), f"SELECT q.id aid, b.id bid, {rounded_sql(_PAIRS['l2'])} dis FROM {E_SQL} q, {E_SQL} b WHERE {_Q_SQL}")
add("cross_distances_l1", lambda s, d: _dis(neighbours.cross_distances(E(s, d).where(_Q), E(s, d), "l1")), f"SELECT q.id aid, b.id bid, {rounded_sql(_PAIRS['l1'])} dis FROM {E_SQL} q, {E_SQL} b WHERE {_Q_SQL}")
add("one_against_all", lambda s, d: _dis(neighbours.cross_distances(E(s, d), E(s, d).where("id = 7"))), f"SELECT q.id aid, b.id bid, {rounded_sql(_PAIRS['l2'])} dis FROM {E_SQL} q, {E_SQL} b WHERE b.id = 7")
add(
    "rerank_shortlist",
    # the shortlist of a query: what has its label
    lambda s, d: _dis(neighbours.rerank(E(s, d).where(_Q).select(F.col("id").alias("qid"), "label").join(E(s, d).select(F.col("id").alias("bid"), "label"), "label"), E(s, d), E(s, d), 5)),
    _knn_sql(_PAIRS["l2"], 5, f"{_Q_SQL} AND b.label = q.label"),
)

# order and rank
add("top_rows", lambda s, d: ordered.top_rows(table(s, d, "orders").select("o_orderkey", "o_totalprice"), 100, "o_totalprice", "o_orderkey"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
add(
    "top_per_group",
    lambda s, d: ordered.top_per_group(table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), 3, ["l_suppkey"], [F.asc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]),
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, r::BIGINT \"rank\" FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) r FROM lineitem) WHERE r <= 3",
)
_ARGSORT = "list_transform(list_sort(list_transform(range(len(iv)), lambda i: {'x': $siv[i + 1], 'i': i})), lambda p: p.i)"
vector_query("top_components", lambda: V.top_positions("iv", 5), f"({_ARGSORT.replace('$s', '-')})[1:5]")
vector_query("sort_vector", lambda: F.sort_array("v"), "list_sort(v)")
vector_query("argsort", lambda: V.argsort("iv"), _ARGSORT.replace("$s", ""))
vector_query("sort_by_permutation", lambda: V.gather("v", V.argsort("v", ascending=False)), "list_reverse_sort(v)")
add(
    "invert_permutation",
    lambda s, d: ordered.invert_permutation(E(s, d).where("id = 3").select(F.posexplode(V.argsort("iv")).alias("i", "p")), "i", "p").select(F.col("i").cast("bigint").alias("i"), F.col("p").cast("bigint").alias("p")),
    f"SELECT p::BIGINT i, (k - 1)::BIGINT p FROM (SELECT generate_subscripts(w, 1) k, unnest(w) p FROM (SELECT {_ARGSORT.replace('$s', '')} w FROM {E_SQL} WHERE id = 3))",
)
for order in ("descending", "ascending"):
    compare = ">" if order == "descending" else "<"
    add(
        f"ranks_{order}",
        lambda s, d, order=order: ordered.ranks_of(table(s, d, "orders"), s.range(40).select((F.col("id") * 10000.0).alias("p")).unionByName(table(s, d, "orders").where("o_orderkey < 100").select(F.col("o_totalprice").alias("p"))), "o_totalprice", "p", order == "descending"),
        f"WITH p AS (SELECT i * 10000.0::DOUBLE p FROM range(40) t(i) UNION ALL SELECT o_totalprice FROM orders WHERE o_orderkey < 100), k AS (SELECT row_number() OVER () k, p FROM p) SELECT p::DOUBLE p, count(*) FILTER (WHERE o_totalprice {compare} p)::BIGINT min_rank, count(*) FILTER (WHERE o_totalprice {compare}= p)::BIGINT max_rank FROM k, orders GROUP BY k, p",
    )
add(
    "as_of_lookup",
    lambda s, d: ordered.as_of(table(s, d, "events").where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), table(s, d, "events").where("event_type = 'purchase'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("last_id")), "ts", "since", ["user_id"], ["last_id"]).select("event_id", "last_id"),
    "SELECT e.event_id, (SELECT arg_max(p.event_id, p.ts) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) last_id FROM events e WHERE e.event_type <> 'purchase'",
)
add("count_matches", lambda s, d: ordered.count_matches(table(s, d, "lineitem"), s.createDataFrame([(1,), (3,), (3,), (999999999,)], "k long"), "l_suppkey", "k"), "SELECT count(*)::BIGINT n FROM lineitem JOIN (VALUES (1), (3), (3), (999999999)) t(k) ON l_suppkey = k")
add("count_unique", lambda s, d: table(s, d, "lineitem").agg(F.count_distinct("l_partkey").alias("n")), "SELECT count(DISTINCT l_partkey)::BIGINT n FROM lineitem")
add(
    "merge_ordered_sets",
    lambda s, d: ordered.merge_ordered([table(s, d, "supplier").select(F.col("s_suppkey").alias("label"), F.lit(1).alias("part")), table(s, d, "customer").select(F.col("c_custkey").alias("label"), F.lit(2).alias("part"))], "label"),
    "SELECT s_suppkey \"label\", 1 part FROM supplier UNION ALL SELECT c_custkey, 2 FROM customer",
)
add(
    "within_ratio_of_least",
    lambda s, d: ordered.within_ratio(table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", ["l_suppkey"], 1.5),
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, min(l_extendedprice) OVER (PARTITION BY l_suppkey) m FROM lineitem) WHERE l_extendedprice < m * 1.5",
)
add(
    "incremental_top",
    lambda s, d: _incremental_top(s, d),
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) r FROM events) WHERE r <= 3",
)
add(
    "running_sum",
    lambda s, d: ordered.running_sum(table(s, d, "events").select("event_id", "user_id", "ts", "value"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", rounded(F.col("running"), 4).alias("running")),
    f"SELECT event_id, {rounded_sql('sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)', 4)} running FROM events",
)
add(
    "running_difference",
    lambda s, d: ordered.differences(table(s, d, "events").select("event_id", "user_id", "ts", "value"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", rounded(F.col("difference"), 4).alias("difference")),
    f"SELECT event_id, {rounded_sql('value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0)', 4)} difference FROM events",
)


def _incremental_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    order = [F.asc("value"), F.asc("event_id")]
    best = ordered.top_per_group(e.where("event_id % 3 = 0"), 3, ["user_id"], order).select("user_id", "event_id", "value")
    for i in (1, 2):
        best = ordered.merge_top(best, e.where(f"event_id % 3 = {i}"), 3, ["user_id"], order)
    return best


# sparse vectors
vector_query("sparse_positions", lambda: F.transform(V.to_sparse("iv"), lambda e: e["idx"]), "list_filter(range(len(iv)), lambda i: iv[i + 1] <> 0)")
vector_query("sparse_round_trip", lambda: V.to_dense(V.to_sparse("iv"), 64), "iv")
scalar_query("sparse_dot", lambda: V.sparse_dot(V.to_sparse("iv"), V.to_sparse(F.reverse("iv"))), "list_sum(list_transform(list_zip(iv, list_reverse(iv)), lambda z: z[1] * z[2]))")

# matrices
_LONG = f"(SELECT id, generate_subscripts(v, 1) - 1 pos, unnest(v) x FROM {E_SQL})"


def _long(s: SparkSession, d: str) -> DataFrame:
    return tables.elements(E(s, d), "v", "id")


for flags in ("nn", "nt", "tn", "tt"):
    # left is n x 64 or its transpose, right 64 x n or its transpose
    add(
        f"matmul_{flags}",
        lambda s, d, flags=flags: linalg.matmul(
            _long(s, d).select(F.col("id" if flags[0] == "n" else "pos").alias("i"), F.col("pos" if flags[0] == "n" else "id").alias("k"), "x"),
            _long(s, d).select(F.col("pos" if flags[1] == "n" else "id").alias("k"), F.col("id" if flags[1] == "n" else "pos").alias("j"), "x"),
            transpose_left=flags[0] == "t",
            transpose_right=flags[1] == "t",
        ).select("i", "j", quickly_rounded(F.col("x")).alias("x")),
        f"SELECT a.id i, b.id j, {rounded_sql('sum(a.x * b.x)')} x FROM {_LONG} a JOIN {_LONG} b USING (pos) GROUP BY a.id, b.id",
    )
add("matrix_vector", lambda s, d: E(s, d).select("id", rounded(V.dot("v", F.array(*[F.lit(float(i % 3)) for i in range(64)]))).alias("x")), f"SELECT id, {rounded_sql('sum(x * (pos % 3))')} x FROM {_LONG} GROUP BY id")
vector_query("submatrix_rows", lambda: F.slice("v", 1, 10), "v[1:10]")
vector_query("pick_dimensions", lambda: V.gather("v", F.array(*map(F.lit, (5, 0, 63)))), "[v[6], v[1], v[64]]")
add(
    "pick_vectors",
    lambda s, d: tables.pick(E(s, d).select("id", "v"), s.createDataFrame([(0, 5), (1, 3), (2, 5)], "place long, want long"), "id", "want").select("place", F.posexplode("v").alias("pos", "x")).select("place", F.col("pos").cast("bigint").alias("pos"), rounded(F.col("x")).alias("x")),
    f"SELECT place::BIGINT place, pos::BIGINT pos, {rounded_sql('x')} x FROM {_LONG} JOIN (VALUES (0, 5), (1, 3), (2, 5)) t(place, want) ON id = want",
)
add(
    "stack_vectors",
    lambda s, d: tables.stack(E(s, d).select("id", "v"), E(s, d).select("id", F.col("r").alias("v")), "id", "v").select("id", F.posexplode("v").alias("pos", "x")).select("id", F.col("pos").cast("bigint").alias("pos"), rounded(F.col("x")).alias("x")),
    f"SELECT id, pos, {rounded_sql('x')} x FROM (SELECT id, generate_subscripts(w, 1)::BIGINT - 1 pos, unnest(w) x FROM (SELECT id, list_concat(v, r) w FROM {E_SQL}))",
)
add(
    "transpose",
    lambda s, d: tables.transpose(E(s, d), "id", "v").select("pos", F.posexplode("v").alias("i", "x")).select("pos", F.col("i").cast("bigint").alias("i"), rounded(F.col("x")).alias("x")),
    f"SELECT pos::BIGINT pos, (row_number() OVER (PARTITION BY pos ORDER BY id) - 1)::BIGINT i, {rounded_sql('x')} x FROM {_LONG}",
)
add(
    "center_columns",
    lambda s, d: tables.elements(linalg.center(E(s, d))[0], "v", "id").select("id", "pos", rounded(F.col("x")).alias("x")),
    f"SELECT id, pos::BIGINT pos, {rounded_sql('x - avg(x) OVER (PARTITION BY pos)')} x FROM {_LONG}",
)
add(
    "covariance",
    lambda s, d: linalg.covariance_table(E(s, d)).select("i", "j", rounded(F.col("c")).alias("c")),
    f"SELECT a.pos::BIGINT i, b.pos::BIGINT j, {rounded_sql('covar_pop(a.x, b.x)')} c FROM {_LONG} a JOIN {_LONG} b USING (id) GROUP BY a.pos, b.pos",
)
add("pca_total_variance", lambda s, d: s.createDataFrame([(round(float(linalg.pca(E(s, d)).values.sum()), 6),)], "total double"), f"SELECT {rounded_sql('sum(v)')} total FROM (SELECT var_pop(x) v FROM {_LONG} GROUP BY pos)")
_GRAM = f"SELECT a.pos i, b.pos j, sum(a.x * b.x) x FROM {_LONG} a JOIN {_LONG} b USING (id) GROUP BY a.pos, b.pos"


def _projected(s: SparkSession, d: str) -> DataFrame:
    """Inner products of all projections with that of vector 0: the same in any orthogonal basis."""
    p = linalg.pca(E(s, d), 64).project(E(s, d))
    first = F.array(*[F.lit(float(x)) for x in p.where("id = 0").first()["p"]])
    return p.select("id", rounded(V.dot("p", first)).alias("x"))


def _power_sums(s: SparkSession, values) -> DataFrame:
    """Sums of powers of eigenvalues over the power of their sum."""
    return s.createDataFrame([(p, round(float(((values / values.sum()) ** p).sum()), 9)) for p in range(1, 5)], "p long, x double")


add("pca_project", _projected, f"SELECT a.id, {rounded_sql('sum(a.x * b.x)')} x FROM (SELECT id, pos, x - avg(x) OVER (PARTITION BY pos) x FROM {_LONG}) a JOIN (SELECT id, pos, x - avg(x) OVER (PARTITION BY pos) x FROM {_LONG}) b USING (pos) WHERE b.id = 0 GROUP BY a.id")
add("svd_values", lambda s, d: _power_sums(s, linalg.svd(E(s, d), 64)[0] ** 2), rounds.power_sums(_GRAM, 4))
add("online_pca", lambda s, d: _online_pca(s, d), f"SELECT {rounded_sql('sum(v)')} total, any_value(n)::BIGINT n FROM (SELECT var_samp(x) v, count(*) n FROM {_LONG} GROUP BY pos)")
add("eigenvalues_of_gram", lambda s, d: _power_sums(s, linalg.eigen(linalg.moments(E(s, d)).gram)[0]), rounds.power_sums(_GRAM, 4))
add("least_squares", lambda s, d: s.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(linalg.least_squares(E(s, d).withColumn("y", V.dot("v", F.array(*[F.lit(float(i)) for i in range(64)])))))], "i long, x double"), "SELECT i::BIGINT i, i::DOUBLE x FROM range(64) t(i)")


def _online_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectide.streaming.state import OnlineMoments

    state = OnlineMoments(64)
    for i in range(3):
        state.add(E(spark, sf_dir).where(f"id % 3 = {i}"))
    return spark.createDataFrame([(round(float(state.covariance().trace()), 6), state.state.n)], "total double, n long")


# binary codes
def codes(s: SparkSession, d: str) -> DataFrame:
    return E(s, d).select("id", "label", V.sign_words("v").alias("code"))


_CODE = f"(SELECT id, label, v, list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) bits FROM {E_SQL})"
_BITS = "list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::BIGINT"
add("sign_bits_set", lambda s, d: codes(s, d).select("id", F.bit_count(F.get("code", 0)).cast("bigint").alias("n")), f"SELECT id, list_sum(bits)::BIGINT n FROM {_CODE}")
add("hamming_distances", lambda s, d: hamming.distances(codes(s, d).where(_Q), codes(s, d)), f"SELECT a.id qid, b.id bid, {_BITS} score FROM {_CODE} a, {_CODE} b WHERE a.id % 50 = 0")
add("hamming_range_join", lambda s, d: hamming.range_join(codes(s, d), codes(s, d), 22), f"SELECT * FROM (SELECT a.id qid, b.id bid, {_BITS} score FROM {_CODE} a, {_CODE} b) WHERE score <= 22")
add("hamming_bands", lambda s, d: hamming.range_join(codes(s, d), codes(s, d), 4), f"SELECT * FROM (SELECT a.id qid, b.id bid, {_BITS} score FROM {_CODE} a, {_CODE} b) WHERE score <= 4")
add("hamming_count", lambda s, d: hamming.count_within(codes(s, d), codes(s, d), 24), f"SELECT count(*)::BIGINT n FROM (SELECT {_BITS} score FROM {_CODE} a, {_CODE} b) WHERE score <= 24")
add("hamming_crossmatch", lambda s, d: hamming.self_join(codes(s, d), 22), f"SELECT * FROM (SELECT a.id qid, b.id bid, {_BITS} score FROM {_CODE} a, {_CODE} b WHERE a.id < b.id) WHERE score <= 22")


# inverted file
def _file(s: SparkSession, d: str) -> inverted.InvertedFile:
    return inverted.InvertedFile.build(codes(s, d).select(F.col("label").alias("key"), "id", "code"), 10)


def _probe(s: SparkSession, d: str) -> DataFrame:
    return codes(s, d).where(_Q).select(F.col("id").alias("qid"), F.col("label").cast("bigint").alias("key"), "code")


add("inverted_sizes", lambda s, d: _file(s, d).sizes(), "SELECT k::BIGINT \"key\", count(label)::BIGINT n FROM range(10) t(k) LEFT JOIN embeddings ON label = k GROUP BY k")
add("inverted_imbalance", lambda s, d: _file(s, d).imbalance().select(rounded(F.col("factor")).alias("factor")), f"SELECT {rounded_sql('count(*) * sum(n * n) / pow(sum(n), 2)')} factor FROM (SELECT count(label)::DOUBLE n FROM range(10) t(k) LEFT JOIN embeddings ON label = k GROUP BY k)")
add("inverted_probe", lambda s, d: _file(s, d).probe(_probe(s, d), 28), f"SELECT * FROM (SELECT a.id qid, b.id bid, a.label::BIGINT \"key\", {_BITS} score FROM {_CODE} a JOIN {_CODE} b USING (label) WHERE a.id % 50 = 0) WHERE score <= 28")
add(
    "inverted_probe_weighted",
    lambda s, d: _file(s, d).probe_weighted(_probe(s, d), 28, inverted.falling_scores(28), s.range(10).select(F.col("id").alias("key"), (F.col("id") + 1.0).alias("w"))).withColumn("score", rounded(F.col("score"))),
    f"SELECT qid, bid, \"key\", {rounded_sql('pow(1 - h / 28.0::DOUBLE, 3) * (key + 1)')} score FROM (SELECT a.id qid, b.id bid, a.label::BIGINT \"key\", {_BITS} h FROM {_CODE} a JOIN {_CODE} b USING (label) WHERE a.id % 50 = 0) WHERE h <= 28",
)
add("inverted_crossmatch", lambda s, d: _file(s, d).crossmatches(26), f"SELECT * FROM (SELECT a.label::BIGINT \"key\", a.id aid, b.id bid, {_BITS} score FROM {_CODE} a JOIN {_CODE} b USING (label) WHERE a.id < b.id) WHERE score <= 26")
add("inverted_crossmatch_symmetric", lambda s, d: _file(s, d).crossmatches(26, symmetric=True), f"SELECT * FROM (SELECT a.label::BIGINT \"key\", a.id aid, b.id bid, {_BITS} score FROM {_CODE} a JOIN {_CODE} b USING (label)) WHERE score <= 26")
add(
    "image_votes",
    lambda s, d: _file(s, d).probe_weighted(_probe(s, d), 28, inverted.falling_scores(28)).groupBy("qid", (F.col("bid") % 50).alias("image")).agg(rounded(F.sum("score")).alias("votes")),
    f"SELECT qid, image, {rounded_sql('sum(pow(1 - h / 28.0::DOUBLE, 3))')} votes FROM (SELECT a.id qid, b.id % 50 image, {_BITS} h FROM {_CODE} a JOIN {_CODE} b USING (label) WHERE a.id % 50 = 0) WHERE h <= 28 GROUP BY qid, image",
)
def _hamming_embedding(s: SparkSession, d: str) -> DataFrame:
    """A codebook of the first 8 vectors, and rows of a Hadamard matrix as rotation; medians are learnt."""
    he = inverted.HammingEmbedding.learn(E(s, d), 8, 32, centroids=E(s, d).where("id < 8").select("id", "v"), rotation=linalg.hadamard(64)[:32] / 8)
    signed = he.signatures(E(s, d))
    return inverted.InvertedFile.build(signed, 8).probe(signed.select(F.col("id").alias("qid"), "key", "code"), 8)


add(
    "hamming_embedding",
    _hamming_embedding,
    f"""WITH e AS (SELECT id, v FROM {E_SQL}), c AS (SELECT id, v FROM e WHERE id < 8),
    a AS (SELECT e.id, arg_min(c.id, {rounds.distance("l2")}) key FROM e, c GROUP BY e.id),
    t AS (SELECT id, key, j, sum(CASE WHEN bit_count(j & pos) % 2 = 0 THEN x ELSE -x END) / 8 x FROM {_LONG} JOIN a USING (id), range(32) h(j) GROUP BY id, key, j),
    b AS (SELECT id, key, list(CASE WHEN x > m THEN 1 ELSE 0 END ORDER BY j) bits FROM (SELECT *, median(x) OVER (PARTITION BY key, j) m FROM t) GROUP BY id, key)
    SELECT * FROM (SELECT a.id qid, b.id bid, a.key::BIGINT "key", {_BITS} score FROM b a JOIN b USING (key)) WHERE score <= 8""",
)


# k-means LSH
add("lsh_knn", lambda s, d: _dis(lsh.approximate_knn(E(s, d).where(_Q), E(s, d), 5)))
add("lsh_recall", lambda s, d: _lsh_recall(s, d), "SELECT true enough")
add("lsh_cell_sizes", lambda s, d: lsh.cell_sizes(lsh.Codebooks.learn(E(s, d), 2, 10).index(E(s, d))))



def _lsh_recall(s: SparkSession, d: str) -> DataFrame:
    """Whether the index finds nine tenths of what exact search finds."""
    found, true = (f(E(s, d).where(_Q), E(s, d), 5).select("qid", "bid") for f in (lsh.approximate_knn, neighbours.knn))
    met = true.join(found.withColumn("found", F.lit(1)), ["qid", "bid"], "left")
    return met.agg((F.count("found") >= 0.9 * F.count("*")).alias("enough"))


# clustering
_ASSIGN = "(SELECT e.id, e.v, arg_min(c.id, list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) c FROM {e} e, {c} c GROUP BY e.id, e.v)"
_UPDATE = "(SELECT c id, list(x ORDER BY pos) v FROM (SELECT c, pos, avg(x) x FROM (SELECT c, generate_subscripts(v, 1) pos, unnest(v) x FROM {a}) GROUP BY c, pos) GROUP BY c)"
_C0 = f"(SELECT id, v FROM {E_SQL} WHERE id < 10)"
_C1 = _UPDATE.format(a=_ASSIGN.format(e=E_SQL, c=_C0))
_C2 = _UPDATE.format(a=_ASSIGN.format(e=E_SQL, c=_C1))
add(
    "kmeans_two_rounds",
    lambda s, d: clustering.kmeans_table(E(s, d), 10, rounds=2, init="first").select("cluster", "pos", rounded(F.col("x")).alias("x")),
    f"SELECT id \"cluster\", pos::BIGINT pos, {rounded_sql('x')} x FROM (SELECT id, generate_subscripts(v, 1) - 1 pos, unnest(v) x FROM {_C2})",
)
_SIZES = "SELECT c \"cluster\", count(*)::BIGINT n FROM a GROUP BY c"
_ABS = E_SQL.replace("embedding::DOUBLE[] v,", "list_transform(embedding::DOUBLE[], lambda x: abs(x)) v,")


def _sizes(s: SparkSession, d: str, k: int, metric: str, n: int) -> DataFrame:
    e = E(s, d).withColumn("v", F.transform("v", F.abs)) if metric == "chi2" else E(s, d)
    return clustering.kmeans(e, k, metric, rounds=n, init="first").assign(e).groupBy("cluster").agg(F.count("*").alias("n"))


for name, k, metric, n in (("converged", 10, "l2", 30), ("l1", 5, "l1", 5), ("chi2", 5, "chi2", 4), ("spherical", 5, "cosine", 8)):
    add(f"kmeans_{name}", lambda s, d, k=k, metric=metric, n=n: _sizes(s, d, k, metric, n), rounds.statement([*rounds.points(_ABS if metric == "chi2" else E_SQL), *rounds.kmeans(k, n, metric)], _SIZES))
add("kmeans_plusplus", lambda s, d: clustering.kmeans(E(s, d), 10, rounds=30, init="plusplus", redo=2).assign(E(s, d)).groupBy("cluster").agg(F.count("*").alias("n")))
add(
    "hierarchical_kmeans",
    lambda s, d: clustering.hierarchical(E(s, d), 3, 2, rounds=5, init="first").quantize(E(s, d)).groupBy("leaf").agg(F.count("*").alias("n")),
    rounds.statement([*rounds.points(E_SQL), *rounds.hierarchy(3, 5)], "SELECT leaf, count(*)::BIGINT n FROM leaf GROUP BY leaf"),
)
add("gaussian_kernel", lambda s, d: clustering.gaussian_kernel(E(s, d), 0.7).select("aid", "bid", quickly_rounded(F.col("x")).alias("x")), f"SELECT q.id aid, b.id bid, CASE WHEN q.id = b.id THEN 0.0 ELSE {rounded_sql('exp(-' + _PAIRS['l2'] + ' / (2 * 0.7 * 0.7))')} END x FROM {E_SQL} q, {E_SQL} b")
add("spectral_clustering", lambda s, d: clustering.spectral(E(s, d), 3, 0.7))


# mixtures
def _mixture(s: SparkSession, d: str) -> mixture.Mixture:
    return mixture.fit(E(s, d), 4, rounds=5, init="first")


def _mixture_table(s: SparkSession, d: str) -> DataFrame:
    both = F.arrays_zip(F.col("mu").alias("mu"), F.col("sigma").alias("sigma"))
    t = _mixture(s, d).table(s).select(F.col("comp").cast("bigint").alias("comp"), "w", F.posexplode(both).alias("pos", "x"))
    return t.select("comp", F.col("pos").cast("bigint").alias("pos"), rounded(F.col("w")).alias("w"), rounded(F.col("x.mu")).alias("mu"), rounded(F.col("x.sigma")).alias("sigma"))


def _fisher(s: SparkSession, d: str, group: str, include: tuple[str, ...]) -> DataFrame:
    found = mixture.fisher(E(s, d), _mixture(s, d), group, include).select(group, F.posexplode("fv").alias("pos", "x"))
    return found.select(group, F.col("pos").cast("bigint").alias("pos"), rounded(F.col("x"), 4).alias("x"))


_EM = rounds.points(E_SQL)
add("gmm_fit", _mixture_table, rounds.statement([*_EM, *rounds.mixture(4, 5)], f"SELECT comp::BIGINT comp, pos - 1 pos, {rounded_sql('w')} w, {rounded_sql('mu')} mu, {rounded_sql('sg')} sigma FROM g JOIN w USING (comp)"))
add(
    "gmm_posteriors",
    lambda s, d: _mixture(s, d).assign(E(s, d)).select("id", F.posexplode("p").alias("comp", "p")).select("id", F.col("comp").cast("bigint").alias("comp"), rounded(F.col("p")).alias("p")),
    rounds.statement([*_EM, *rounds.mixture(4, 5)], f"SELECT id, comp::BIGINT comp, {rounded_sql('p')} p FROM p"),
)
add("fisher_vector", lambda s, d: _fisher(s, d, "label", ("w", "mu", "sigma")), rounds.statement([*_EM, *rounds.fisher(4, 5, "label", ("w", "mu", "sigma"))], f"SELECT g \"label\", pos::BIGINT pos, {rounded_sql('x', 4)} x FROM f"))
add("fisher_vector_each", lambda s, d: _fisher(s, d, "id", ("mu",)), rounds.statement([*_EM, *rounds.fisher(4, 5, "id", ("mu",))], f"SELECT g id, pos::BIGINT pos, {rounded_sql('x', 4)} x FROM f"))

# descriptors
_NEAR = _ASSIGN.format(e="(SELECT id, v FROM " + E_SQL + ")", c="(SELECT id, v FROM " + E_SQL + " WHERE id < 8)")
add(
    "vlad",
    lambda s, d: descriptors.vlad(E(s, d), E(s, d).where("id < 8").select("id", "v"), "label").select("label", "cluster", "pos", rounded(F.col("x")).alias("x")),
    f"""WITH a AS (SELECT label, c, pos, sum(x - cx) x FROM (SELECT e.label, n.c, generate_subscripts(e.v, 1) - 1 pos, unnest(e.v) x, unnest(k.v) cx FROM {_NEAR} n JOIN {E_SQL} e USING (id) JOIN {E_SQL} k ON k.id = n.c) GROUP BY ALL)
    SELECT l.label, k::BIGINT "cluster", p::BIGINT pos, {rounded_sql('coalesce(x, 0)')} x FROM (SELECT DISTINCT label FROM embeddings) l, range(8) t(k), range(64) u(p) LEFT JOIN a ON a.label = l.label AND c = k AND a.pos = p""",
)
add(
    "vlad_weighted",
    lambda s, d: descriptors.vlad(E(s, d).withColumn("w", F.col("id") % 3 + 0.5), E(s, d).where("id < 8").select("id", "v"), "label", weight="w").groupBy("label", "cluster").agg(rounded(F.sum("x")).alias("x")),
    f"""WITH a AS (SELECT e.label, n.c, sum((e.id % 3 + 0.5::DOUBLE) * (list_sum(e.v) - list_sum(k.v))) x FROM {_NEAR} n JOIN {E_SQL} e USING (id) JOIN {E_SQL} k ON k.id = n.c GROUP BY ALL)
    SELECT l.label, k::BIGINT "cluster", {rounded_sql('coalesce(x, 0)')} x FROM (SELECT DISTINCT label FROM embeddings) l, range(8) t(k) LEFT JOIN a ON a.label = l.label AND c = k""",
)
add(
    "bag_of_features",
    lambda s, d: descriptors.bag_of_features(E(s, d), E(s, d).where("id < 8").select("id", "v"), "label"),
    f"SELECT l.label, k::BIGINT \"cluster\", count(n.c)::BIGINT n FROM (SELECT DISTINCT label FROM embeddings) l CROSS JOIN range(8) t(k) LEFT JOIN (SELECT e.label, n.c FROM {_NEAR} n JOIN {E_SQL} e USING (id)) n ON n.label = l.label AND n.c = k GROUP BY ALL",
)
add(
    "bag_of_features_multiple",
    lambda s, d: descriptors.bag_of_features(E(s, d), E(s, d).where("id < 8").select("id", "v"), "label", k=3),
    f"SELECT l.label, k::BIGINT \"cluster\", count(n.bid)::BIGINT n FROM (SELECT DISTINCT label FROM embeddings) l CROSS JOIN range(8) t(k) LEFT JOIN (SELECT e.label, n.bid FROM ({_knn_sql(_PAIRS['l2'], 3, 'b.id < 8')}) n JOIN embeddings e ON e.vec_id = n.qid) n ON n.label = l.label AND n.bid = k GROUP BY ALL",
)
vector_query("poly2_embedding", lambda: V.poly2(F.slice("v", 1, 12)), "flatten(list_transform(range(1, 13), lambda i: list_transform(range(i, 13), lambda j: v[i] * v[j] * CASE WHEN i = j THEN 1 ELSE sqrt(2) END)))")
scalar_query("poly3_embedding_norm", lambda: V.norm(V.poly3(F.slice("v", 1, 8))), "pow(list_sum(list_transform(v[1:8], lambda x: x * x)), 1.5)")
vector_query("angular_modulation", lambda: V.angular(F.slice("v", 1, 6), F.col("id") % 7 * 0.3, [0.5, 1.0, 0.25]), "list_concat(list_concat(list_concat(list_concat(list_transform(v[1:6], lambda x: 0.5 * x), list_transform(v[1:6], lambda x: x * cos(id % 7 * 0.3))), list_transform(v[1:6], lambda x: 0.25 * x * cos(2 * (id % 7 * 0.3)))), list_transform(v[1:6], lambda x: x * sin(id % 7 * 0.3))), list_transform(v[1:6], lambda x: 0.25 * x * sin(2 * (id % 7 * 0.3))))")


add(
    "modulated_by_label",
    lambda s, d: descriptors.modulated(E(s, d).withColumn("angle", F.col("id") % 7 * 0.3).withColumn("v", F.slice("v", 1, 6)), "angle", [0.5, 1.0], 1, "label").select("label", F.posexplode("m").alias("pos", "x")).select("label", F.col("pos").cast("bigint").alias("pos"), rounded(F.col("x")).alias("x")),
    f"""SELECT label, pos::BIGINT pos, {rounded_sql('sum(x)')} x FROM (SELECT label, generate_subscripts(w, 1) - 1 pos, unnest(w) x FROM (SELECT label,
    list_concat(list_concat(list_transform(v[1:6], lambda x: 0.5 * x), list_transform(v[1:6], lambda x: x * cos(id % 7 * 0.3))), list_transform(v[1:6], lambda x: x * sin(id % 7 * 0.3))) w FROM {E_SQL})) GROUP BY label, pos""",
)
add(
    "average_precision",
    lambda s, d: ordered.average_precision(_judged(s, d), "qid", "rank", "relevant", "total").select("qid", rounded(F.col("ap")).alias("ap")),
    f"""WITH k AS ({_knn_sql(_PAIRS['l2'], 50)}), j AS (SELECT qid, "rank" r, b.label = q.label rel FROM k JOIN embeddings q ON q.vec_id = qid JOIN embeddings b ON b.vec_id = bid),
    h AS (SELECT *, sum(rel::INT) OVER (PARTITION BY qid ORDER BY r) c FROM j)
    SELECT qid, {rounded_sql('sum((CASE WHEN r > 1 THEN (c - 1) / (r - 1) ELSE 1 END + c / r) / 2) / max(t.n)')} ap FROM h JOIN embeddings q ON q.vec_id = qid JOIN (SELECT label, count(*) n FROM embeddings GROUP BY label) t ON t.label = q.label WHERE rel GROUP BY qid""",
)


def _judged(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select("vec_id", "label")
    near = neighbours.knn(E(s, d).where(_Q), E(s, d), 50).join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql")), "qid").join(e.select(F.col("vec_id").alias("bid"), F.col("label").alias("bl")), "bid")
    return near.join(e.groupBy(F.col("label").alias("ql")).agg(F.count("*").alias("total")), "ql").withColumn("relevant", F.col("ql") == F.col("bl"))


# files and streams
def _round_trip(s: SparkSession, d: str, elem: str) -> DataFrame:
    from vectide.sources import shared, vecfiles

    path = shared.new_path(s, "vectors")
    column = {"f32": F.col("v").cast("array<float>"), "i32": F.col("iv").cast("array<int>"), "i64": F.col("iv"), "u8": F.transform("iv", lambda x: (x + 100).cast("smallint"))}[elem]
    vecfiles.write_vectors(E(s, d).select(column.alias("v")).coalesce(2), path, elem)
    return vecfiles.read_vectors(s, path, elem=elem).select(F.posexplode("v").alias("pos", "x")).groupBy(F.col("pos").cast("bigint").alias("pos")).agg(rounded(F.sum(F.col("x").cast("double")), 4).alias("total"), F.count("*").alias("n"))


for elem, body in {"f32": "v", "i32": "iv", "i64": "iv", "u8": "list_transform(iv, lambda x: x + 100)"}.items():
    add(f"file_round_trip_{elem}", lambda s, d, elem=elem: _round_trip(s, d, elem), f"SELECT pos::BIGINT pos, {rounded_sql('sum(x)', 4)} total, count(*)::BIGINT n FROM (SELECT generate_subscripts(w, 1) - 1 pos, unnest(w)::DOUBLE x FROM (SELECT {body} w FROM {E_SQL})) GROUP BY pos")
