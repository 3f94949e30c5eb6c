"""SQL of iterative methods: their rounds written out as common table expressions, for tables that one machine holds.

``source`` is a query with id, label and v (doubles); vectors have ``D`` elements, as those of the driver's tables.
"""

from __future__ import annotations

D = 64
#: Newton steps written out for a chi-square centroid; they double the right digits.
STEPS = 10

_SUM = "list_sum(list_transform(list_zip({a}.v, {b}.v), lambda z: {body}))"
DISTANCES = {
    "l2": "(z[1] - z[2]) * (z[1] - z[2])",
    "l1": "abs(z[1] - z[2])",
    "chi2": "CASE WHEN z[1] + z[2] <> 0 THEN pow(z[1] - z[2], 2) / (z[1] + z[2]) ELSE 0 END",
    "cosine": "-(z[1] * z[2])",
}
_NORMED = "list_transform({v}, lambda y: y / sqrt(list_sum(list_transform({v}, lambda z: z * z))))"


def distance(metric: str, a: str = "e", b: str = "c") -> str:
    return _SUM.format(a=a, b=b, body=DISTANCES[metric])


def points(source: str) -> list[str]:
    return [f"e AS MATERIALIZED (SELECT id, label, v FROM {source})", "x AS MATERIALIZED (SELECT id, label, generate_subscripts(v, 1) pos, unnest(v) x FROM e)"]


def _assigned(metric: str, centroids: str, group: str | None = None) -> str:
    """id, c, dis; with ``group`` (a table id, g) within groups."""
    dis = distance(metric)
    if group:
        return f"SELECT e.id, g.g, arg_min(c.c, {dis}) c, min({dis}) dis FROM e JOIN {group} g USING (id) JOIN {centroids} c ON c.g = g.g GROUP BY e.id, g.g"
    return f"SELECT e.id, arg_min(c.c, {dis}) c, min({dis}) dis FROM e, {centroids} c GROUP BY e.id"


def _newton(r: int) -> list[str]:
    """Centroids n{r} (c, pos, x) of the members of a{r}, by Newton steps from the mean."""
    out = [f"s{r}_0 AS MATERIALIZED (SELECT c, pos, greatest(avg(x.x), 0) y FROM a{r} JOIN x USING (id) GROUP BY c, pos)"]
    for k in range(STEPS):
        d = "(y - x.x) * (y + 3 * x.x) / pow(CASE WHEN y + x.x > 0 THEN y + x.x ELSE 1 END, 2)"
        dd = "8 * x.x * x.x / pow(CASE WHEN y + x.x > 0 THEN y + x.x ELSE 1 END, 3)"
        step = f"SELECT s.c, s.pos, y, CASE WHEN sum({dd}) > 0 THEN y - sum({d}) / sum({dd}) ELSE y END n FROM a{r} a JOIN x USING (id) JOIN s{r}_{k} s ON s.c = a.c AND s.pos = x.pos GROUP BY s.c, s.pos, y"
        out.append(f"s{r}_{k + 1} AS MATERIALIZED (SELECT c, pos, CASE WHEN n < 0 THEN y / 2 ELSE n END y FROM ({step}))")
    return [*out, f"n{r} AS (SELECT c, pos, y x FROM s{r}_{STEPS})"]


def kmeans(k: int, rounds: int, metric: str = "l2") -> list[str]:
    """c0 (c, v): the k smallest ids; a1, c1 and so on: assignments and centroids of each round; a: assignments to the last."""
    first = _NORMED.format(v="v") if metric == "cosine" else "v"
    out = [f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 c, {first} v FROM e ORDER BY id LIMIT {k})"]
    for r in range(1, rounds + 1):
        out.append(f"a{r} AS MATERIALIZED ({_assigned(metric, f'c{r - 1}')})")
        if metric == "chi2":
            out += _newton(r)
        else:
            out.append(f"n{r} AS (SELECT c, pos, {'median' if metric == 'l1' else 'avg'}(x) x FROM a{r} JOIN x USING (id) GROUP BY c, pos)")
        new = f"SELECT c, list(x ORDER BY pos) v FROM n{r} GROUP BY c"
        out.append(f"c{r} AS MATERIALIZED ({f'SELECT c, {_NORMED.format(v="v")} v FROM ({new})' if metric == 'cosine' else new})")
    return [*out, f"a AS MATERIALIZED ({_assigned(metric, f'c{rounds}')})"]


def statement(parts: list[str], query: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + query


def hierarchy(branches: int, rounds: int) -> list[str]:
    """Two levels; leaf (id, leaf)."""
    out = [*kmeans(branches, rounds), "g1 AS MATERIALIZED (SELECT id, c g FROM a)"]
    out.append(f"b0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY id) - 1 c, v FROM e JOIN g1 USING (id) QUALIFY c < {branches})")
    for r in range(1, rounds + 1):
        out.append(f"h{r} AS MATERIALIZED ({_assigned('l2', f'b{r - 1}', 'g1')})")
        out.append(f"b{r} AS MATERIALIZED (SELECT g, c, list(x ORDER BY pos) v FROM (SELECT h.g, h.c, pos, avg(x) x FROM h{r} h JOIN x USING (id) GROUP BY h.g, h.c, pos) GROUP BY g, c)")
    return [*out, f"leaf AS (SELECT id, {branches} * g + c leaf FROM ({_assigned('l2', f'b{rounds}', 'g1')}))"]


def mixture(k: int, rounds: int, start: int = 20, cut: float = 16.636, floor: float = 1e-10) -> list[str]:
    """Expectation maximisation from k-means: w (comp, w), g (comp, pos, mu, sg), p (id, comp, p) of the fitted mixture."""
    out = [*kmeans(k, start), f"w0 AS (SELECT c comp, 1.0::DOUBLE / {k} w FROM c0)"]
    out.append(f"g0 AS MATERIALIZED (SELECT c comp, generate_subscripts(v, 1) pos, unnest(v) mu, (SELECT greatest(avg(dis) / {D}, {floor}) FROM a{start}) sg FROM c{start})")

    def posteriors(r: int, name: str) -> list[str]:
        quad = f"ln(greatest(w, 1e-300)) - 0.5 * ({D} * ln(2 * pi()) + sum(ln(sg)) + sum((x - mu) * (x - mu) / sg))"
        return [
            f"l{name} AS MATERIALIZED (SELECT id, comp, {quad} l FROM x JOIN g{r} USING (pos) JOIN w{r} USING (comp) GROUP BY id, comp, w)",
            f"u{name} AS (SELECT id, comp, CASE WHEN l - m < -{cut} THEN 0 ELSE exp(l - m) END u FROM (SELECT *, max(l) OVER (PARTITION BY id) m FROM l{name}))",
            f"p{name} AS MATERIALIZED (SELECT id, comp, u / sum(u) OVER (PARTITION BY id) p FROM u{name})",
        ]

    for r in range(1, rounds + 1):
        out += posteriors(r - 1, str(r))
        out.append(f"t{r} AS MATERIALIZED (SELECT comp, pos, sum(p) sp, sum(p * x) px, sum(p * x * x) pxx FROM p{r} JOIN x USING (id) GROUP BY comp, pos)")
        out.append(f"g{r} AS MATERIALIZED (SELECT comp, pos, px / sp mu, greatest((pxx + mu * (mu * sp - 2 * px)) / sp, {floor}) sg FROM t{r} JOIN g{r - 1} USING (comp, pos))")
        out.append(f"w{r} AS MATERIALIZED (SELECT comp, sp / (SELECT sum(sp) FROM t{r} WHERE pos = 1) w FROM t{r} WHERE pos = 1)")
    return [*out, *posteriors(rounds, ""), f"g AS (FROM g{rounds})", f"w AS (FROM w{rounds})"]


def fisher(k: int, rounds: int, group: str, include: tuple[str, ...]) -> list[str]:
    """f (g, pos, x): gradients in the order w, mu, sigma."""
    out = [*mixture(k, rounds), f"q AS MATERIALIZED (SELECT {group} g, comp, pos, count(*) n, sum(p) sp, sum(p * x) px, sum(p * x * x) pxx FROM p JOIN x USING (id) GROUP BY {group}, comp, pos)"]
    parts, at = [], 0
    if "w" in include:
        parts.append("SELECT a.g, a.comp - 1 pos, (a.sp / w.w - b.sp / w0.w) / sqrt(a.n * (1 / w.w + 1 / w0.w)) x FROM q a JOIN q b ON b.g = a.g AND b.comp = 0 AND b.pos = 1 JOIN w ON w.comp = a.comp JOIN w w0 ON w0.comp = 0 WHERE a.comp > 0 AND a.pos = 1")
        at += k - 1
    for kind in ("mu", "sigma"):
        if kind in include:
            x = "(px - mu * sp) / sg / sqrt(n * w / sg)" if kind == "mu" else "(pxx - 2 * mu * px + sp * (mu * mu - sg)) / (sg * sqrt(2 * n * w))"
            parts.append(f"SELECT q.g, {at} + q.comp * {D} + q.pos - 1 pos, {x} x FROM q JOIN g USING (comp, pos) JOIN w USING (comp)")
            at += k * D
    return [*out, f"f AS ({' UNION ALL '.join(parts)})"]


def power_sums(gram: str, most: int) -> str:
    """p, x: trace(m^p) / trace(m)^p of a matrix (i, j, x), which its eigenvalues alone determine."""
    parts = [f"m1 AS MATERIALIZED ({gram})"]
    parts += [f"m{p} AS MATERIALIZED (SELECT a.i, b.j, sum(a.x * b.x) x FROM m{p - 1} a JOIN m1 b ON a.j = b.i GROUP BY a.i, b.j)" for p in range(2, most + 1)]
    sums = " UNION ALL ".join(f"SELECT {p}::BIGINT p, sum(x) / pow((SELECT sum(x) FROM m1 WHERE i = j), {p}) x FROM m{p} WHERE i = j" for p in range(1, most + 1))
    return statement(parts, f"SELECT p, round(x, 9) x FROM ({sums})")
