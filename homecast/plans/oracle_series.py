"""DuckDB SQL for the series models M3, M4, M11, M12, M15 and their forecasts.

Each query is (further CTEs, final SELECT) over the CTEs of ``oracle``.  The models are
recomputed by other means than the library's: normal equations by elimination instead of the
Levinson recursion, recursive CTEs instead of folds, closed forms and dense elimination
instead of tree passes.
"""

from __future__ import annotations

BANDS = (("lo80", "-", 1.2815515655446004), ("hi80", "+", 1.2815515655446004),
         ("lo95", "-", 1.959963984540054), ("hi95", "+", 1.959963984540054))


def s7(x: str, name: str) -> str:
    """Seven significant digits."""
    return f"CAST(printf('%.6e', {x}) AS DOUBLE) AS {name}"


def forecast_columns(keys: str = "") -> str:
    return (f"{keys}month, round(mean, 4) AS mean, round(sigma, 4) AS sigma, "
            + ", ".join(f"round(mean {s} {z} * sigma, 4) AS {c}" for c, s, z in BANDS))


def total(body: str, upto: str) -> str:
    """Sum over j = 1..upto of an expression in j."""
    return f"coalesce(list_sum(list_transform(range(1, ({upto}) + 1), lambda j: {body})), 0.0)"


# ------------------------------------------------------------------------ M11, M13
def ar(src: str, key: str, value: str, p: str = "ar", steps: str | None = None) -> str:
    """CTEs up to ``<p>best`` (key, n, d, p, phi, mean, sigma2, aicc, kpss) and, given
    ``steps`` (SQL for the number of steps), ``<p>fc`` (key, month, mean, sigma).  ``key`` is a
    column list that every CTE carries."""
    by = f"PARTITION BY {key} ORDER BY t"
    out = f"""
{p}y AS (SELECT {key}, month, CAST({value} AS DOUBLE) AS y, row_number() OVER (PARTITION BY {key} ORDER BY month) AS t
  FROM {src}),
{p}d AS (SELECT *, y1 - lag(y1) OVER ({by}) AS y2 FROM (SELECT *, y - lag(y) OVER ({by}) AS y1 FROM {p}y)),
{p}w AS (SELECT {key}, t, d, w FROM (
  SELECT {key}, t, 0 AS d, y AS w FROM {p}d UNION ALL SELECT {key}, t, 1, y1 FROM {p}d UNION ALL
  SELECT {key}, t, 2, y2 FROM {p}d) WHERE w IS NOT NULL),
{p}e AS (SELECT *, w - mean AS e FROM (
  SELECT *, CASE WHEN d < 2 THEN avg(w) OVER (PARTITION BY {key}, d) ELSE 0.0 END AS mean,
    count(*) OVER (PARTITION BY {key}, d) AS n FROM {p}w)),
{p}s AS (SELECT {key}, d, max(n) AS n, max(mean) AS mean, sum(s * s) AS ss FROM (
  SELECT *, sum(e) OVER (PARTITION BY {key}, d ORDER BY t) AS s FROM {p}e) GROUP BY {key}, d),
{p}g AS (SELECT {key}, d, list(g ORDER BY k) AS g FROM (
  SELECT {key}, d, k, coalesce(sum(e * f), 0.0) / max(n) AS g FROM (
    SELECT *, t - k AS u FROM (SELECT *, unnest(range(0, 13)) AS k FROM {p}e)) LEFT JOIN (
    SELECT {key}, d, t AS u, e AS f FROM {p}e) USING ({key}, d, u) GROUP BY {key}, d, k)
  GROUP BY {key}, d),
{p}k AS (SELECT *, ss / nullif(n * n * (g[1] + 2 * {total(
    "greatest(0.0, 1 - j / (floor(4 * pow(n / 100.0, 0.25)) + 1.0)) * g[j + 1]", "12")}), 0) AS kpss
  FROM {p}s JOIN {p}g USING ({key}, d)),
{p}pick AS (SELECT {key}, max(kpss) FILTER (d = 0) AS kpss, CASE WHEN coalesce(max(kpss) FILTER (d = 0), 0) < 0.463
  THEN 0 WHEN coalesce(max(kpss) FILTER (d = 1), 0) < 0.463 THEN 1 ELSE 2 END AS d FROM {p}k GROUP BY {key}),
{p}c AS (SELECT {key}, d, n, mean, g, q.kpss FROM {p}k JOIN {p}pick q USING ({key}, d)),
{p}j AS (SELECT {key}, p, 0 AS k, list_transform(range(p * (p + 1)), lambda q: CASE WHEN q % (p + 1) = p
    THEN g[q // (p + 1) + 2] ELSE g[abs(q // (p + 1) - q % (p + 1)) + 1] END) AS a
  FROM (SELECT *, unnest(range(1, 6)) AS p FROM {p}c)
  UNION ALL SELECT {key}, p, k + 1, list_transform(range(p * (p + 1)), lambda q: CASE WHEN q // (p + 1) = k
    THEN a[q + 1] / a[k * (p + 1) + k + 1]
    ELSE a[q + 1] - a[(q // (p + 1)) * (p + 1) + k + 1] * a[k * (p + 1) + q % (p + 1) + 1] / a[k * (p + 1) + k + 1] END)
  FROM {p}j WHERE k < p),
{p}o AS (SELECT {key}, 0 AS p, []::DOUBLE[] AS phi FROM {p}c UNION ALL
  SELECT {key}, p, list_transform(range(1, p + 1), lambda i: a[i * (p + 1)]) FROM {p}j WHERE k = p),
{p}v AS (SELECT *, g[1] - {total("phi[j] * g[j + 1]", "p")} AS v FROM {p}o JOIN {p}c USING ({key})),
{p}a AS (SELECT *, CASE WHEN v > 0 AND n > p + 3 THEN n * ln(v) + 2 * (p + 2) + 2.0 * (p + 2) * (p + 3) / (n - p - 3) END
    AS aicc, CASE WHEN n > p + 1 THEN v * n / (n - p - 1) END AS sigma2 FROM {p}v),
{p}best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY coalesce(aicc, 'inf'::DOUBLE), p) AS rn
  FROM {p}a WHERE p = 0 OR aicc IS NOT NULL) WHERE rn = 1)"""
    if steps is None:
        return out
    phi = lambda i: (f"(CASE WHEN {i} = 0 THEN 1.0 WHEN {i} < 0 OR {i} > p THEN 0.0 ELSE -phi[{i}] END)")
    return out + f""",
{p}m AS (SELECT *, list_transform(range(1, p + d + 1), lambda j: -CASE d WHEN 0 THEN {phi('j')}
    WHEN 1 THEN {phi('j')} - {phi('(j - 1)')} ELSE {phi('j')} - 2 * {phi('(j - 1)')} + {phi('(j - 2)')} END) AS a,
    mean * (1 - {total("phi[j]", "p")}) AS c, p + d AS size, {steps} AS horizon FROM {p}best),
{p}l AS (SELECT {key}, list(y ORDER BY month DESC) AS ys, max(month) AS last_index FROM {p}y GROUP BY {key}),
{p}f AS (SELECT {key}, 0 AS step, last_index, a, c, size, horizon, sigma2, ys[1:size] AS ys, []::DOUBLE[] AS psis,
    0.0::DOUBLE AS x, 0.0::DOUBLE AS var FROM {p}m JOIN {p}l USING ({key})
  UNION ALL SELECT {key}, step + 1, last_index, a, c, size, horizon, sigma2, list_prepend(x, ys)[1:size],
    list_prepend(psi, psis)[1:size], x, var + psi * psi FROM (
    SELECT * REPLACE (c + {total("a[j] * ys[j]", "size")} AS x), CASE WHEN step = 0 THEN 1.0 ELSE
      {total("a[j] * coalesce(psis[j], 0.0)", "size")} END AS psi FROM {p}f WHERE step < horizon)),
{p}fc AS (SELECT {key}, (last_index + to_months(CAST(step AS INTEGER)))::DATE AS month, x AS mean,
    sqrt(sigma2 * var) AS sigma FROM {p}f WHERE step > 0)"""


def ar_report(key: str, p: str = "ar") -> str:
    """One row per term of the fit."""
    terms = [("kpss", "kpss"), ("mean", "mean"), ("sigma2", "sigma2"), ("aicc", "aicc")]
    rows = [f"SELECT {key}, CAST(d AS INTEGER) AS d, CAST(p AS INTEGER) AS ar_order, '{t}' AS term, {s7(x, 'estimate')} "
            f"FROM {p}best" for t, x in terms]
    rows.append(f"SELECT {key}, CAST(d AS INTEGER), CAST(p AS INTEGER), 'ar' || i AS term, {s7('phi[i]', 'estimate')} "
                f"FROM (SELECT *, unnest(range(1, p + 1)) AS i FROM {p}best)")
    return " UNION ALL ".join(rows)


# ------------------------------------------------------------------------ M12, M13
def ets(src: str, key: str, value: str, p: str = "es", horizon: int | None = None) -> str:
    """CTEs up to ``<p>best`` (key, parameters, level, slope, s, sse, aicc, sigma2) and
    ``<p>fc``.  The recursion goes through time for all keys and parameter sets at once."""
    out = f"""
{p}y AS (SELECT {key}, month, CAST({value} AS DOUBLE) AS y, row_number() OVER (PARTITION BY {key} ORDER BY month) AS t
  FROM {src}),
{p}0 AS (SELECT {key}, count(*) AS n, max(month) AS last_index, list(y ORDER BY t) AS ys,
    avg(y) FILTER (t <= 10) AS m10, coalesce(regr_slope(y, t) FILTER (t <= 10), 0.0) AS s10,
    coalesce(regr_intercept(y, t) FILTER (t <= 10), avg(y) FILTER (t <= 10)) AS i10,
    avg(y) FILTER (t <= 12) AS c1, avg(y) FILTER (t BETWEEN 13 AND 24) AS c2 FROM {p}y GROUP BY {key}),
{p}1 AS (SELECT *, (c2 - c1) / 12 AS rise FROM {p}0),
{p}2 AS (SELECT *, c1 - 6.5 * rise AS base, list_transform(range(1, 13), lambda i:
    (ys[i] + ys[i + 12]) / 2 - (c1 - 6.5 * rise) - rise * (i + 6)) AS s12 FROM {p}1),
{p}p AS (SELECT CASE WHEN phi = 0 THEN 'N' WHEN phi = 1 THEN 'A' ELSE 'Ad' END AS trend,
    CASE WHEN g = 0 THEN 'N' ELSE 'A' END AS season, alpha, CASE WHEN phi = 0 THEN 0.0 ELSE alpha * b END AS beta,
    CASE WHEN g = 0 THEN 0.0 ELSE (1 - alpha) * g END AS gamma, CASE WHEN phi = 0 THEN 0.0 ELSE phi END AS phi
  FROM (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])::DOUBLE AS alpha),
    (SELECT unnest([0.0, 0.05, 0.2, 0.5])::DOUBLE AS g), (SELECT unnest([0.05, 0.2, 0.5])::DOUBLE AS b),
    (SELECT unnest([0.0, 1.0, 0.9, 0.98])::DOUBLE AS phi) WHERE phi > 0 OR b = 0.05),
{p}r AS (SELECT {key}, n, last_index, ys, trend, season, alpha, beta, gamma, phi, 0 AS t,
    CASE WHEN season = 'A' THEN CASE WHEN trend = 'N' THEN (c1 + c2) / 2 ELSE base END
         WHEN trend = 'N' THEN m10 ELSE i10 END AS l,
    CASE WHEN trend = 'N' THEN 0.0 WHEN season = 'A' THEN rise ELSE s10 END AS b,
    CASE WHEN season = 'A' THEN s12 ELSE [0.0] END AS s, 0.0::DOUBLE AS sse
  FROM {p}2, {p}p WHERE season = 'N' OR n >= 24
  UNION ALL SELECT {key}, n, last_index, ys, trend, season, alpha, beta, gamma, phi, t + 1,
    l + phi * b + alpha * e, phi * b + beta * e,
    CASE WHEN season = 'A' THEN list_append(s[2:12], s[1] + gamma * e) ELSE s END, sse + e * e
  FROM (SELECT *, ys[t + 1] - l - phi * b - s[1] AS e FROM {p}r WHERE t < n)),
{p}k AS (SELECT *, 3 + CASE trend WHEN 'N' THEN 0 WHEN 'A' THEN 2 ELSE 3 END + CASE season WHEN 'A' THEN 13 ELSE 0 END AS k
  FROM {p}r WHERE t = n),
{p}a AS (SELECT *, n * ln(sse / n) + 2 * k + 2.0 * k * (k + 1) / (n - k - 1) AS aicc, sse / (n - k) AS sigma2 FROM {p}k
  WHERE n - k - 1 > 0),
{p}best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY aicc) AS rn FROM {p}a) WHERE rn = 1)"""
    if horizon is None:
        return out
    powers = total("pow(phi, j)", "u")
    c = f"(alpha + beta * {powers} + CASE WHEN u % 12 = 0 THEN gamma ELSE 0.0 END)"
    return out + f""",
{p}u AS (SELECT *, {powers} AS run, {c} AS c FROM (SELECT *, unnest(range(1, {horizon} + 1)) AS u FROM {p}best)),
{p}fc AS (SELECT {key}, (last_index + to_months(CAST(u AS INTEGER)))::DATE AS month,
    l + b * run + CASE WHEN season = 'A' THEN s[(u - 1) % 12 + 1] ELSE 0.0 END AS mean,
    sqrt(sigma2 * (1 + coalesce(sum(c * c) OVER (PARTITION BY {key} ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0.0))) AS sigma FROM {p}u)"""


def ets_report(key: str, p: str = "es") -> str:
    return (f"SELECT {key}, trend, season, alpha, beta, gamma, {s7('phi', 'phi')}, {s7('l', 'level')}, {s7('b', 'slope')}, "
            f"{s7('sse', 'sse')}, {s7('sigma2', 'sigma2')}, {s7('aicc', 'aicc')} FROM {p}best").replace(
        "alpha, beta, gamma", ", ".join(s7(c, c) for c in ("alpha", "beta", "gamma")), 1)


# ------------------------------------------------------------------------------- M3
def _local(src: str, out: str, value: str, at: str, n: str, span: int, degree: int, part: str, weight: str) -> str:
    """CTE ``out``: ``src`` with ``fit``, the local regression at every row, by a self join on
    the rows within reach."""
    half = (span - 1) // 2
    left = f"greatest(1, least({at} - {half}, {n} - {span} + 1))"
    reach = f"(greatest({at} - lo, hi - {at}) + greatest(0, floor(({span} - {n}) / 2.0)))"
    g = (f"CASE WHEN abs(b.j - a.j) <= 0.001 * a.reach THEN 1.0 WHEN abs(b.j - a.j) <= 0.999 * a.reach "
         f"THEN pow(1 - pow(abs(b.j - a.j) / a.reach, 3), 3) ELSE 0.0 END * b.r")
    line = "avg_y + (0 - avg_x) * cov / var" if degree else "avg_y"
    flat = f"var > 0 AND sqrt(var) > 0.001 * (n - 1)" if degree else "true"
    return f"""
{out}_a AS (SELECT *, {at} AS j, CAST({reach} AS DOUBLE) AS reach FROM (
  SELECT *, {left} AS lo, least({n}, {left} + {span} - 1) AS hi FROM {src})),
{out}_b AS (SELECT {part} AS part, {at} AS j, CAST({value} AS DOUBLE) AS v, CAST({weight} AS DOUBLE) AS r FROM {src}
  WHERE {value} IS NOT NULL),
{out}_s AS (SELECT t, n, sum(g) AS g, sum(g * x) / sum(g) AS avg_x, sum(g * v) / sum(g) AS avg_y,
    sum(g * x * x) / sum(g) - pow(sum(g * x) / sum(g), 2) AS var,
    sum(g * x * v) / sum(g) - sum(g * x) / sum(g) * sum(g * v) / sum(g) AS cov
  FROM (SELECT a.t, a.{n} AS n, b.j - a.j AS x, b.v, {g} AS g FROM {out}_a a JOIN {out}_b b
        ON a.{part} = b.part AND b.j BETWEEN a.lo AND a.hi) WHERE g > 0 GROUP BY t, n),
{out} AS (SELECT s.*, coalesce(CASE WHEN {flat} THEN {line} ELSE avg_y END, {value}) AS fit
  FROM {src} s LEFT JOIN {out}_s q ON s.t = q.t)"""


def stl(src: str, value: str, outer: int, p: str = "st") -> tuple[str, str]:
    import numpy as np

    ma = np.convolve(np.convolve([1 / 12] * 12, [1 / 12] * 12), [1 / 3] * 3)
    low = ", ".join(f"({k - 12}, {float(x)!r}::DOUBLE)" for k, x in enumerate(ma))
    ctes = [f"""
{p}own AS (SELECT month, CAST({value} AS DOUBLE) AS y, row_number() OVER (ORDER BY month) AS t FROM {src}),
{p}ma AS (SELECT * FROM (VALUES {low}) AS q(k, w)),
{p}x0 AS (SELECT t, y, nt, one, 0.0::DOUBLE AS trend, 1.0::DOUBLE AS rho, (t + 11) % 12 AS pos, (t + 11) // 12 AS c,
    CAST(count(y) OVER (PARTITION BY (t + 11) % 12) AS BIGINT) AS nc
  FROM (SELECT g.t, y, 1 AS one, (SELECT count(*) FROM {p}own) AS nt FROM
        (SELECT unnest(range(-11, (SELECT count(*) FROM {p}own) + 13)) AS t) g LEFT JOIN {p}own USING (t)))"""]
    last, no = f"{p}x0", 0
    for turn in range(outer + 1):
        for _ in range(2):
            no += 1
            q = f"{p}{no}"
            old = "trend, seasonal" if last.endswith("x") else "trend"
            ctes.append(f"{q}d AS (SELECT * EXCLUDE ({old}), y - trend AS d FROM {last})")
            ctes.append(_local(f"{q}d", f"{q}c", "d", "c", "nc", 11, 0, "pos", "rho"))
            ctes.append(f"""
{q}l AS (SELECT a.*, CASE WHEN a.y IS NOT NULL THEN low END AS low FROM {q}c a LEFT JOIN (
  SELECT a.t, sum(b.fit * w) AS low FROM {q}c a, {p}ma JOIN {q}c b ON b.t = a.t + k GROUP BY a.t) l ON a.t = l.t)""")
            ctes.append(_local(f"(SELECT * EXCLUDE (fit), fit AS cycle FROM {q}l)", f"{q}m", "low", "t", "nt", 13, 1, "one", "1.0"))
            ctes.append(f"""
{q}s AS (SELECT * EXCLUDE (fit, low, d), CASE WHEN y IS NOT NULL THEN cycle - fit END AS seasonal,
    y - (cycle - fit) AS v FROM {q}m)""")
            ctes.append(_local(f"{q}s", f"{q}t", "v", "t", "nt", 21, 1, "one", "rho"))
            ctes.append(f"{q}x AS (SELECT * EXCLUDE (fit, cycle, v), fit AS trend FROM {q}t)")
            last = f"{q}x"
        if turn < outer:
            ctes.append(f"""
{q}r AS (SELECT * REPLACE (CASE WHEN u <= 0.001 THEN 1.0 WHEN u <= 0.999 THEN pow(1 - u * u, 2) WHEN u > 0.999 THEN 0.0
    ELSE 1.0 END AS rho) FROM (SELECT *, abs(y - seasonal - trend) / (6 * (SELECT median(abs(y - seasonal - trend))
    FROM {q}x)) AS u FROM {q}x))""")
            ctes.append(f"{q}z AS (SELECT * EXCLUDE (u, seasonal) FROM {q}r)")
            last = f"{q}z"
    return "," + ",".join(ctes), (
        f"SELECT month, round(y, 4) AS y, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, "
        f"round(y - trend - seasonal, 4) AS remainder, round(y - seasonal, 4) AS season_adjust "
        f"FROM {last} JOIN (SELECT month, t FROM {p}own) USING (t)")


# ------------------------------------------------------------------------------- M4
def _filter_table(weights: list[float], ends: dict[int, list[float]]) -> str:
    """VALUES of (values before, values after, offset, weight), both counts up to half the length."""
    h, rows = len(weights) // 2, []
    for b in range(h + 1):
        for a in range(h + 1):
            if b == h and a == h:
                ws = {k: weights[k + h] for k in range(-h, h + 1)}
            elif b == h:
                ws = dict(zip(range(-h, a + 1), ends[h - a]))
            elif a == h:
                ws = {-k: x for k, x in zip(range(-h, b + 1), ends[h - b])}
            else:
                have = {k: weights[k + h] for k in range(-b, a + 1)}
                ws = {k: x / sum(have.values()) for k, x in have.items()}
            rows += [f"({b}, {a}, {k}, {float(x)!r}::DOUBLE)" for k, x in ws.items()]
    return f"(VALUES {', '.join(rows)}) AS f(b, a, k, w)"


def _least_revised(weights: list[float], missing: int) -> list[float]:
    """End filter by its definition: weights that sum to one and whose result differs least,
    in mean square, from the centred filter's on a line plus noise (ratio 3.5)."""
    import numpy as np

    n = len(weights)
    full, m = np.array(weights), n - missing
    at, slope2 = np.arange(n, dtype=float), 4 / (np.pi * 3.5 ** 2)
    a = np.eye(m) + slope2 * np.outer(at[:m], at[:m])
    b = full[:m] + slope2 * at[:m] * (at @ full)
    system = np.block([[a, np.ones((m, 1))], [np.ones((1, m)), np.zeros((1, 1))]])
    return list(np.linalg.solve(system, np.r_[b, 1.0])[:m])


def _apply(src: str, out: str, value: str, part: str, table: str, h: int) -> str:
    """CTE ``out``: ``src`` with ``f``, the filtered ``value`` of its rows that have one."""
    return f"""
{out}_i AS (SELECT month, {part} AS part, {value} AS v, row_number() OVER (PARTITION BY {part} ORDER BY month) AS i,
    count(*) OVER (PARTITION BY {part}) AS c FROM {src} WHERE {value} IS NOT NULL),
{out}_f AS (SELECT x.month, sum(w * o.v) AS f FROM {out}_i x JOIN {table} ON f.b = least(x.i - 1, {h}) AND f.a = least(x.c - x.i, {h})
  JOIN {out}_i o ON o.part = x.part AND o.i = x.i + f.k GROUP BY x.month),
{out} AS (SELECT s.*, f FROM {src} s LEFT JOIN {out}_f USING (month))"""


def _near(c: str, part: str) -> str:
    by = f"({part} ORDER BY month ROWS BETWEEN "
    return (f"coalesce(last_value({c} IGNORE NULLS) OVER {by}UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({c} IGNORE NULLS) OVER {by}CURRENT ROW AND UNBOUNDED FOLLOWING))")


def _centred(c: str) -> str:
    w = "OVER (ORDER BY month ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING)"
    return f"CASE WHEN count({c}) {w.format(6)} = 13 THEN (sum({c}) {w.format(6)} + sum({c}) {w.format(5)}) / 24 END"


def _x11_pass(src: str, y: str, p: str) -> str:
    """CTE ``<p>z``: ``src`` with s (season), a (adjusted) and tr (trend) of ``y``."""
    from .oracle import _smoothest

    h13 = _smoothest(13)
    t13 = _filter_table(h13, {g: _least_revised(h13, g) for g in range(1, 7)})
    t33 = _filter_table([1 / 9, 2 / 9, 3 / 9, 2 / 9, 1 / 9], {2: [5 / 27, 11 / 27, 11 / 27], 1: [1 / 9, 7 / 27, 10 / 27, 7 / 27]})
    t35 = _filter_table([1 / 15, 2 / 15, 3 / 15, 3 / 15, 3 / 15, 2 / 15, 1 / 15], {
        3: [.15, 17 / 60, 17 / 60, 17 / 60], 2: [1 / 15, 11 / 60, .25, .25, .25], 1: [1 / 15, 2 / 15, 13 / 60, 13 / 60, 13 / 60, .15]})

    def season(source: str, out: str, table: str, h: int) -> str:
        return (_apply(source, f"{out}1", "si", "pos", table, h) + f""",
{out}2 AS (SELECT * REPLACE ({_near('f', 'PARTITION BY pos')} AS f) FROM {out}1),
{out}3 AS (SELECT *, {_centred('f')} AS c FROM {out}2),
{out} AS (SELECT * EXCLUDE (f, c, si), f - {_near('c', '')} AS s FROM {out}3)""")

    return (f"\n{p}a AS (SELECT *, {y} - {_centred(y)} AS si FROM {src}),"
            + season(f"{p}a", f"{p}b", t33, 2)
            + f",\n{p}c AS (SELECT * EXCLUDE (s), {y} - s AS a FROM {p}b)," + _apply(f"{p}c", f"{p}d", "a", "0", t13, 6)
            + f",\n{p}e AS (SELECT * EXCLUDE (f, a), {y} - f AS si FROM {p}d)," + season(f"{p}e", f"{p}f", t35, 3)
            + f",\n{p}g AS (SELECT *, {y} - s AS a FROM {p}f)," + _apply(f"{p}g", f"{p}h", "a", "0", t13, 6)
            + f",\n{p}z AS (SELECT * EXCLUDE (f), f AS tr FROM {p}h)")


def x11(src: str, value: str, passes: int = 2) -> tuple[str, str]:
    around = "OVER (ORDER BY month ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)"
    ctes = f""",
xb0 AS (SELECT month, CAST({value} AS DOUBLE) AS y, (row_number() OVER (ORDER BY month) - 1) % 12 AS pos FROM {src}),
xb1 AS (SELECT *, y - {_centred('y')} AS si FROM xb0),
xb2 AS (SELECT *, CASE WHEN si IS NOT NULL THEN median(si) OVER (PARTITION BY pos, si IS NULL ORDER BY month
    ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS f FROM xb1),
xb3 AS (SELECT month, y, pos, y - {_near('f', 'PARTITION BY pos')} AS a FROM xb2),
xi0 AS (SELECT month, y, pos, a - median(a) OVER (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS i FROM xb3)"""
    for n in range(passes):
        ctes += f""",
xs{n} AS (SELECT *, sqrt(avg(i * i) {around}) AS s0 FROM xi{n}),
xt{n} AS (SELECT *, coalesce(sqrt(avg(CASE WHEN abs(i) < 2.5 * s0 THEN i * i END) {around}), 0.0) AS s1 FROM xs{n}),
xm{n} AS (SELECT month, y, pos, y - (1 - CASE WHEN s1 <= 0 OR abs(i) <= 1.5 * s1 THEN 1.0
    WHEN abs(i) >= 2.5 * s1 THEN 0.0 ELSE 2.5 - abs(i) / s1 END) * i AS ym FROM xt{n}),""" + _x11_pass(f"xm{n}", "ym", f"x{n}") + f""",
xi{n + 1} AS (SELECT month, y, pos, y - s - tr AS i, s, tr FROM x{n}z)"""
    return ctes, (f"SELECT month, round(y, 4) AS y, round(tr, 4) AS trend, round(s, 4) AS seasonal, "
                  f"round(y - s - tr, 4) AS remainder, round(y - s, 4) AS season_adjust FROM xi{passes}")


# ------------------------------------------------------------------------------ M15
def _node_ts() -> str:
    """CTE ``node_ts``: totals per node ('' for all, region, region > county) and month."""
    names = ("''", "Region", "Region || ' > ' || County")
    sums = " UNION ALL ".join(f"SELECT {n} AS node, month, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) AS price "
                              f"FROM si_all GROUP BY ALL" for n in names)
    return f""",
node_m AS ({sums}),
node_ts AS (SELECT node, month, coalesce(price, 0.0) AS price FROM (SELECT DISTINCT node FROM node_m) CROSS JOIN (
  SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH))::DATE AS month FROM (
    SELECT min(month) AS lo, max(month) AS hi FROM node_m)) LEFT JOIN node_m USING (node, month)),
tree AS (SELECT node, CASE WHEN node = '' THEN NULL WHEN contains(node, ' > ') THEN string_split(node, ' > ')[1] ELSE '' END
  AS up FROM (SELECT DISTINCT node FROM node_m))"""


#: Least squares in closed form: with q = S' y, the leaves are q - (region sum) - (total).
_OLS = """,
y AS (SELECT node, up, month, mean FROM arfc JOIN tree USING (node)),
q AS (SELECT l.node, l.up, l.month, l.mean + r.mean + a.mean AS q FROM y l JOIN y r ON r.node = l.up AND r.month = l.month
  JOIN y a ON a.node = '' AND a.month = l.month WHERE contains(l.node, ' > ')),
qr AS (SELECT up, month, sum(q) AS q, count(*) AS n FROM q GROUP BY up, month),
qa AS (SELECT month, sum(q / (1 + n)) / (1 + sum(n / (1.0 + n))) AS total FROM qr GROUP BY month),
br AS (SELECT up, month, (q - n * total) / (1 + n) AS b, total FROM qr JOIN qa USING (month)),
leafs AS (SELECT node, month, q - b - total AS mean FROM q JOIN br USING (up, month)),
coherent AS (SELECT node, month, mean FROM leafs UNION ALL SELECT up, month, b FROM br UNION ALL SELECT '', month, total FROM qa)"""

#: One-step errors, and their covariance and intensity by pairs of nodes.
_ERRORS = """,
er AS (SELECT node, month, y - c - coalesce(list_sum(list_transform(range(1, size + 1), lambda j: a[j] * back[j])), 0.0) AS e
  FROM (SELECT *, list(y) OVER (PARTITION BY node ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fwd,
          list_reverse(fwd) AS back FROM ary) JOIN arm USING (node) WHERE size = 0 OR len(fwd) >= size),
ef AS (SELECT * FROM er WHERE month IN (SELECT month FROM er GROUP BY month HAVING count(*) = (SELECT count(*) FROM tree))),
sd AS (SELECT node, sqrt(avg(e * e)) AS sd, count(*) AS nt FROM ef GROUP BY node),
cv AS (SELECT a.node AS i, b.node AS j, sum(a.e * b.e) / max(nt) AS c,
    sum(a.e * b.e) / max(sa.sd) / max(sb.sd) AS r, sum(a.e * a.e * b.e * b.e) / max(sa.sd * sa.sd * sb.sd * sb.sd) AS r2,
    max(nt) AS nt FROM ef a JOIN ef b USING (month) JOIN sd sa ON sa.node = a.node
  JOIN (SELECT node, sd FROM sd) sb ON sb.node = b.node GROUP BY 1, 2),
lam AS (SELECT least(1.0, greatest(0.0, sum((r2 - r * r / nt) / (nt * (nt - 1))) / sum(r * r / (nt * nt)))) AS shrink,
    max(nt) AS nt FROM cv WHERE i <> j)"""

_GAINS = """,
w AS (SELECT i, j, CASE WHEN i = j THEN c ELSE (1 - shrink) * c END AS w FROM cv, lam),
inr AS (SELECT up AS par, row_number() OVER (ORDER BY up) - 1 AS no FROM (SELECT DISTINCT up FROM tree WHERE up IS NOT NULL)),
um AS (SELECT node, par, no, CASE WHEN node = par THEN 1.0 WHEN up = par THEN -1.0 END AS u FROM tree, inr WHERE node = par OR up = par),
wu AS (SELECT i AS node, par, no, sum(w * u) AS wu FROM w JOIN um ON um.node = w.j GROUP BY 1, 2, 3),
uwu AS (SELECT um.no AS r, wu.no AS c, sum(u * wu) AS v FROM um JOIN wu ON wu.node = um.node GROUP BY 1, 2),
kn AS (SELECT count(*) AS k FROM inr),
gj AS (SELECT 0::BIGINT AS step, k, list(v ORDER BY r, c) AS a FROM (
    SELECT r, c, v FROM uwu UNION ALL SELECT x.no, y.no + k, CASE WHEN x.no = y.no THEN 1.0 ELSE 0.0 END FROM inr x, inr y, kn), kn GROUP BY k
  UNION ALL SELECT step + 1, k, list_transform(range(k * 2 * k), lambda q: CASE WHEN q // (2 * k) = step
    THEN a[q + 1] / a[step * 2 * k + step + 1] ELSE a[q + 1] - a[(q // (2 * k)) * 2 * k + step + 1]
      * a[step * 2 * k + q % (2 * k) + 1] / a[step * 2 * k + step + 1] END) FROM gj WHERE step < k),
inv AS (SELECT x.no AS r, y.no AS c, y.par, a[x.no * 2 * k + k + y.no + 1] AS v FROM gj, inr x, inr y WHERE step = k),
gain AS (SELECT node, inv.par, -sum(wu * v) AS gain FROM wu JOIN inv ON inv.r = wu.no GROUP BY 1, 2)"""

_MINT = """,
gap AS (SELECT par, month, sum(u * mean) AS u FROM um JOIN arfc USING (node) GROUP BY 1, 2),
minted AS (SELECT f.node, f.month, max(f.mean) + sum(gain * u) AS mean FROM arfc f JOIN gain g ON g.node = f.node
  JOIN gap p ON p.par = g.par AND p.month = f.month GROUP BY 1, 2)"""


#: The series of every menu entry: sales of one county, beds and baths in three months or more.
_MENU = """
, menu_m AS (SELECT County, beds, baths, month, mean_sale FROM (
  SELECT County, beds, baths, month, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price) AS mean_sale,
    count(*) OVER (PARTITION BY County, beds, baths) AS months FROM si_app GROUP BY County, beds, baths, month) WHERE months >= 3),
menu_ts AS ({gaps})"""


def _views() -> dict[str, tuple[str, str]]:
    from .oracle import _VIEW, _dollar, gapfill

    state = _VIEW + "," + ar("(SELECT 1 AS one, * FROM ts_app)", "one", "mean_sale", steps="12")
    chosen = _VIEW + "," + ar("(SELECT 1 AS one, * FROM sel_ts)", "one", "mean_sale", steps="36")
    menu = _MENU.replace("{gaps}", gapfill("menu_m", ["County", "beds", "baths"], ["mean_sale"], "0.0")) + "," + ar(
        "menu_ts", "County, beds, baths", "mean_sale", steps="12")
    label = " || ".join(f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '') || ' {c}'" for c in ("beds", "baths")).replace(
        "' beds' || ", "' beds, ' || ")
    table = (f"SELECT month, strftime(month, '%Y %b') AS \"Date\", round(mean - last_sale, 4) AS price_diff, "
             f"{_dollar('mean - last_sale')} AS price_diff_text, round(mean, 4) AS total_sale, {_dollar('mean')} AS total_sale_text, "
             f"strftime(base_month, '%Y %b') AS base_month FROM arfc, last_sale")
    return {"Q6_ar": (state, f"SELECT {forecast_columns()} FROM arfc"),
            "Q6_ar_selection": (chosen, f"SELECT {forecast_columns()} FROM arfc"),
            "Q6_ar_menu": (menu, f"SELECT {forecast_columns('County, ' + label + ' AS bdba, ')} FROM arfc"),
            "Q7_ar": (state, table)}


_AR = "," + ar("ts_region", "Region", "mean_sale", steps="12")
_NODES = _node_ts() + "," + ar("node_ts", "node", "price", steps="5")
_ETS = "," + ets("ts_region", "Region", "mean_sale", horizon=24)
QUERIES = {
    "M11_region": (_AR, ar_report("Region")),
    "M13_ar": (_AR, f"SELECT {forecast_columns('Region, ')} FROM arfc"),
    "M12_region": (_ETS, ets_report("Region")),
    "M13_ets": (_ETS, f"SELECT {forecast_columns('Region, ')} FROM esfc"),
    "M3": stl("ts_mean", "mean_sale", 0),
    "M3_robust": stl("ts_mean", "mean_sale", 1),
    "M4": x11("ts_mean", "mean_sale"),
    "M15_ols": (_NODES + _OLS, f"SELECT node, month, {s7('mean', 'mean')} FROM coherent"),
    "M15_shrinkage": (_NODES + _ERRORS, f"SELECT (SELECT count(*) FROM tree) AS nodes, nt AS months, {s7('shrink', 'intensity')} FROM lam"),
    "M15_gains": (_NODES + _ERRORS + _GAINS, f"SELECT node, par AS \"at\", {s7('round(gain, 6) + 0.0', 'gain')} FROM gain"),
    "M15_mint": (_NODES + _ERRORS + _GAINS + _MINT, f"SELECT node, month, {s7('mean', 'mean')} FROM minted"),
}


QUERIES.update(_views())
