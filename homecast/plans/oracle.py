"""DuckDB SQL that recomputes every registered query independently.

The common table expressions below rebuild the stand-in inputs and the
cleaned/joined facts with DuckDB's own functions; each query appends its
final SELECT.  Column names and types match the Spark output.
"""

from __future__ import annotations

def _month(col: str) -> str:
    """Parts between separators; two-digit years from 69 on are of the 1900s."""
    p = f"string_split_regex(trim({col}), '[-/. ,]+')"
    year = (f"CASE WHEN length({p}[3]) = 4 THEN TRY_CAST({p}[3] AS INTEGER) WHEN length({p}[3]) = 2 THEN "
            f"TRY_CAST({p}[3] AS INTEGER) + CASE WHEN TRY_CAST({p}[3] AS INTEGER) < 69 THEN 2000 ELSE 1900 END END")
    return (f"CASE WHEN len({p}) = 3 THEN date_trunc('month', TRY_CAST(({year}) || '-' || lpad({p}[1], 2, '0') || '-' "
            f"|| lpad({p}[2], 2, '0') AS DATE))::DATE END")


def _money(col: str) -> str:
    return f"TRY_CAST(regexp_replace({col}, '[$,]', '', 'g') AS DOUBLE)"


def _part(col: str, sep: str, i: int) -> str:
    return f"string_split({col}, '{sep}')[{i + 1}]"


_STATEZIP = _part("address", ", ", 2)
_SPLIT_ADDR = (f"{_part('address', ', ', 0)} AS street, {_part('address', ', ', 1)} AS city, "
               f"{_part(_STATEZIP, ' ', 0)} AS state, {_part(_STATEZIP, ' ', 1)} AS zip")

BASE = f"""
props AS (
  SELECT c_custkey, c_nationkey, c_acctbal,
         CAST(c_custkey AS VARCHAR) || ' Oak St' AS street, c_mktsegment AS city, 'IN' AS state,
         CAST(46000 + c_nationkey * 4 + c_custkey % 5 AS VARCHAR) AS zip
  FROM customer),
history_raw AS (
  SELECT CASE WHEN o.o_orderkey % 101 = 7 THEN p.street || ', ' || p.city
              WHEN o.o_orderkey % 101 = 41
                THEN p.street || ', Apt 4, ' || p.city || ', ' || p.state || ' ' || p.zip
              ELSE p.street || ', ' || p.city || ', ' || p.state || ' ' || p.zip END AS address,
         CASE WHEN o.o_orderkey % 101 = 29 THEN strftime(o.o_orderdate, '%-m/%-d/%y')
              WHEN o.o_orderkey % 101 = 53 THEN strftime(o.o_orderdate, '13/%-d/%Y')
              WHEN o.o_orderkey % 101 = 59 THEN strftime(o.o_orderdate, '%m-%d-%Y')
              ELSE strftime(o.o_orderdate, '%-m/%-d/%Y') END AS "Date",
         CASE o.o_orderstatus WHEN 'F' THEN 'Sold' WHEN 'O' THEN 'Listed for sale'
              WHEN 'P' THEN 'Price change' END AS Event,
         CASE WHEN o.o_orderkey % 101 = 13 THEN '--'
              WHEN o.o_orderstatus = 'P' THEN '$' || format('{{:,.2f}}', o.o_totalprice)
                   || ' (-' || CAST(o.o_orderkey % 10 AS VARCHAR) || '.5%)'
              ELSE '$' || format('{{:,.2f}}', o.o_totalprice) END AS Price
  FROM orders o JOIN props p ON o.o_custkey = p.c_custkey),
info_raw AS (
  SELECT '/homedetails/' || CAST(c_custkey AS VARCHAR) || '_zpid/' AS link,
         street || ', ' || city || ', ' || state || ' ' || zip AS address,
         CAST(c_custkey % 6 AS INTEGER) AS beds,
         CAST(c_custkey % 4 AS DOUBLE) * 0.5 + 1.0 AS baths,
         c_acctbal AS sqft
  FROM props),
county_zips AS (
  SELECT County, CAST(46000 + k * 4 + j AS VARCHAR) AS zip
  FROM (SELECT n_name AS County, n_nationkey AS k, unnest(generate_series(0, 4)) AS j FROM nation)),
county_regions AS (
  SELECT n_name AS County, r_name AS Region FROM nation JOIN region ON n_regionkey = r_regionkey),
cpi AS (
  SELECT m AS month, 100.0 + 0.25 * ((year(m) - 1995) * 12 + month(m) - 1) AS "Index"
  FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders)),
h AS (
  SELECT {_month('"Date"')} AS month,
         {_part(_STATEZIP, ' ', 1)} AS zip, {_part('address', ', ', 0)} AS street,
         {_part('address', ', ', 1)} AS city, {_part(_STATEZIP, ' ', 0)} AS state, Event,
         {_money(_part('Price', ' ', 0))} AS price
  FROM history_raw),
h_text AS (
  SELECT {_SPLIT_ADDR}, "Date", Event, {_part('Price', ' ', 0)} AS price FROM history_raw),
i_rep AS (
  SELECT link, {_SPLIT_ADDR}, beds, baths, sqft FROM info_raw WHERE beds > 0 AND baths > 0),
i_app AS (SELECT * FROM i_rep WHERE sqft > 0),
zr_all AS (
  SELECT cz.zip, cz.County, cr.Region FROM county_zips cz LEFT JOIN county_regions cr USING (County)),
zr_viz AS (SELECT DISTINCT zip, Region FROM zr_all),
zr_app AS (
  SELECT zip, County, Region FROM (
    SELECT *, row_number() OVER (PARTITION BY County ORDER BY zip, Region) AS rn
    FROM (SELECT DISTINCT * FROM zr_all)) WHERE rn = 1),
hi_app AS (
  SELECT DISTINCT h.month, h.zip, h.street, h.city, h.state, h.Event, h.price,
         i.link, i.beds, i.baths, i.sqft, z.County, z.Region
  FROM h LEFT JOIN i_app i ON h.zip = i.zip AND h.street = i.street AND h.city = i.city
                            AND h.state = i.state
         LEFT JOIN zr_app z ON h.zip = z.zip
  WHERE h.month IS NOT NULL AND h.zip IS NOT NULL AND h.street IS NOT NULL
    AND h.city IS NOT NULL AND h.state IS NOT NULL AND h.Event IS NOT NULL
    AND h.price IS NOT NULL AND i.link IS NOT NULL AND i.beds IS NOT NULL
    AND i.baths IS NOT NULL AND i.sqft IS NOT NULL AND z.County IS NOT NULL
    AND z.Region IS NOT NULL),
si_app AS (SELECT * FROM hi_app WHERE Event = 'Sold'),
si_all AS (
  SELECT * FROM (
    SELECT DISTINCT h.month, h.zip, h.street, h.city, h.state, h.Event, h.price,
           i.link, i.beds, i.baths, i.sqft, z.County, z.Region
    FROM h LEFT JOIN i_app i ON h.zip = i.zip AND h.street = i.street AND h.city = i.city
                              AND h.state = i.state
           LEFT JOIN zr_all z ON h.zip = z.zip
    WHERE h.month IS NOT NULL AND h.zip IS NOT NULL AND h.street IS NOT NULL
      AND h.city IS NOT NULL AND h.state IS NOT NULL AND h.Event IS NOT NULL
      AND h.price IS NOT NULL AND i.link IS NOT NULL AND i.beds IS NOT NULL
      AND i.baths IS NOT NULL AND i.sqft IS NOT NULL AND z.County IS NOT NULL
      AND z.Region IS NOT NULL) WHERE Event = 'Sold'),
si_viz AS (
  SELECT * FROM (
    SELECT DISTINCT h.month, h.zip, h.street, h.city, h.state, h.Event, h.price,
           i.link, i.beds, i.baths, i.sqft, z.Region
    FROM h LEFT JOIN i_rep i ON h.zip = i.zip AND h.street = i.street AND h.city = i.city
                              AND h.state = i.state
           LEFT JOIN zr_viz z ON h.zip = z.zip
    WHERE h.month IS NOT NULL AND h.zip IS NOT NULL AND h.street IS NOT NULL
      AND h.city IS NOT NULL AND h.state IS NOT NULL AND h.Event IS NOT NULL
      AND h.price IS NOT NULL AND i.link IS NOT NULL AND i.beds IS NOT NULL
      AND i.baths IS NOT NULL AND i.sqft IS NOT NULL AND z.Region IS NOT NULL)
  WHERE Event = 'Sold'),
sold_info AS (
  SELECT s.street, s.city, s.state, s.zip, s."Date", s.Event, s.price,
         i.link, i.beds, i.baths, i.sqft
  FROM h_text s LEFT JOIN i_rep i ON s.zip = i.zip AND s.street = i.street
                                   AND s.city = i.city AND s.state = i.state
  WHERE s.Event = 'Sold'),
si_rep AS (
  SELECT {_month('s."Date"')} AS month, cz.County, s.street, s.city, s.state, s.zip, s.Event,
         {_money('s.price')} AS price, s.link, s.beds, s.baths, s.sqft
  FROM (SELECT * FROM sold_info
        WHERE street IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL AND zip IS NOT NULL
          AND "Date" IS NOT NULL AND Event IS NOT NULL AND price IS NOT NULL
          AND link IS NOT NULL AND beds IS NOT NULL AND baths IS NOT NULL
          AND sqft IS NOT NULL) s
  LEFT JOIN county_zips cz ON s.zip = cz.zip),
si_cc AS (
  SELECT * FROM si_rep
  WHERE month IS NOT NULL AND County IS NOT NULL AND price IS NOT NULL)
"""

_BUCKET = ("CASE WHEN sqft <= 1000 THEN '0-1000 sqft' "
           "WHEN sqft > 1000 AND sqft < 1500 THEN '1000-1500 sqft' "
           "WHEN sqft >= 1500 THEN '1500+ sqft' END")


def _num_text(c: str) -> str:
    return f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"


_OPTIONS = f"""
  SELECT {_num_text('beds')} AS beds, {_num_text('baths')} AS baths, County,
         {_num_text('beds')} || ' beds, ' || {_num_text('baths')} || ' baths' AS bdba
  FROM (SELECT beds, baths, County, count(DISTINCT month) AS n FROM si_app
        GROUP BY beds, baths, County HAVING count(DISTINCT month) >= 3)"""

_ADJ = """
  SELECT month, (CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price)) AS mean_sale, round(avg(price_adj), 4) AS mean_adj
  FROM (SELECT s.*, c."Index", s.price / c."Index" * 100 AS price_adj
        FROM si_rep s LEFT JOIN cpi c ON s.month = c.month)
  WHERE month IS NOT NULL AND County IS NOT NULL AND price IS NOT NULL AND price_adj IS NOT NULL
  GROUP BY month"""

FINAL = {
    "B1": "SELECT * FROM h",
    "B2": "SELECT * FROM i_app",
    "B3_first_zip": "SELECT zip, County, Region FROM zr_app",
    "B3_zip_region": "SELECT * FROM zr_viz",
    "B3_all": "SELECT * FROM zr_all",
    "B4": "SELECT * FROM si_app",
    "B4_viz": "SELECT * FROM si_viz",
    "B5": "SELECT * FROM si_rep",
    "B6_listed": "SELECT * FROM h WHERE Event = 'Listed for sale'",
    "B6_changes": ("SELECT address, \"Date\", Event, string_split(Price, ' ')[1] AS \"to\", "
                   "string_split(Price, ' ')[2] AS pct FROM history_raw WHERE Event = 'Price change'"),
    "A1": "SELECT month, (CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price)) AS mean_sale FROM si_app GROUP BY month",
    "A2": ("SELECT month, (CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price)) AS mean_sale, round(avg(baths), 4) AS mean_baths, "
           "round(avg(beds), 4) AS mean_beds FROM si_app GROUP BY month"),
    "A3": "SELECT month, County, (CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price)) AS mean_sale FROM si_cc GROUP BY month, County",
    "A4": "SELECT month, Region, (CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price)) AS mean_sale FROM si_viz GROUP BY month, Region",
    "A5": ("SELECT date_trunc('quarter', month)::DATE AS quarter, (CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price)) AS mean_sale "
           "FROM si_cc GROUP BY 1"),
    "A6": ("SELECT CAST(year(month) AS INTEGER) AS year, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) AS total_sales, "
           "count(*) AS count_sales FROM si_cc GROUP BY 1"),
    "A7": ("SELECT month, County, CASE WHEN count(price) = count(*) THEN CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) END "
           "AS total_sales, count(*) AS count_sales FROM si_rep GROUP BY month, County"),
    "A8": "SELECT month, count(*) AS count_sales FROM si_cc GROUP BY month",
    "A9": "SELECT month, round(median(price), 4) AS median_sale FROM si_viz GROUP BY month",
    "A10": ("SELECT month, Region, round(median(price), 4) AS median_sale FROM si_viz "
            "GROUP BY month, Region"),
    "A11": ("SELECT month, round(median(sqft), 4) AS median_sqft, round(median(price), 4) AS "
            "median_price, round(median(baths), 4) AS median_baths, "
            "round(median(beds::DOUBLE), 4) AS median_beds FROM si_cc GROUP BY month"),
    "A12": (f"SELECT month, {_BUCKET} AS sq_int, Region, (CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price)) AS mean_sale "
            "FROM si_viz GROUP BY ALL"),
    "A13": (f"SELECT month, {_BUCKET} AS sq_int, Region, round(median(price), 4) AS median_sale "
            "FROM si_viz GROUP BY ALL"),
    "A14": (f"SELECT month, {_BUCKET} AS sq_int, (CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price)) AS mean_sale "
            "FROM si_viz GROUP BY ALL"),
    "A15": (f"SELECT month, {_BUCKET} AS sq_int, round(median(price), 4) AS median_sale "
            "FROM si_viz GROUP BY ALL"),
    "A16": ("SELECT month, zip, County, beds, baths, (CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price)) AS mean_sale, "
            "round(avg(sqft), 4) AS mean_sqft FROM si_cc GROUP BY month, zip, County, beds, baths"),
    "A17": _OPTIONS,
    "A18": ("SELECT County, beds, baths, min(sqft) AS mini, max(sqft) AS maxi FROM si_app "
            "GROUP BY County, beds, baths"),
    "A19": ("SELECT month, round(avg(price_sqft), 4) AS mean_pricesqft FROM ("
            "SELECT month, CASE WHEN sqft = 0 THEN NULL ELSE price / sqft END AS price_sqft "
            "FROM si_cc) WHERE price_sqft <> 75000 GROUP BY month"),
    "A20": _ADJ,
    "P10": (f"SELECT month, name, Price, CASE WHEN name IN ('mean_sale', "
            f"'mean_adj') THEN name END AS level FROM (SELECT month, 'mean_sale' AS name, mean_sale "
            f"AS Price FROM ({_ADJ}) UNION ALL SELECT month, 'mean_adj', mean_adj FROM ({_ADJ}))"),
    "A21": ("SELECT month, (CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price)) AS mean_sale FROM si_app WHERE County = 'NATION_3' "
            "AND beds = 3 AND baths = 1.5 AND sqft BETWEEN 1000 AND 5000 GROUP BY month"),
    "A22": f"SELECT DISTINCT County FROM ({_OPTIONS}) ORDER BY County",
    "A23": ("SELECT month, Region, County, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) AS total_sales, "
            "count(*) AS count_sales, CAST(GROUPING(Region, County) AS INTEGER) AS level FROM si_all "
            "GROUP BY ROLLUP (month, Region, County) HAVING GROUPING(month) = 0"),
}


def _decimal_round(q: str) -> str:
    """Rewrite ``round(x, d)`` as ``round(CAST(x AS DECIMAL(38,10)), d)::DOUBLE``,
    the rounding rule of the Spark side."""
    out, i = [], 0
    while True:
        j = q.find("round(", i)
        if j < 0 or (j > 0 and (q[j - 1].isalnum() or q[j - 1] == "_")):
            if j < 0:
                out.append(q[i:])
                return "".join(out)
            out.append(q[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 0, j + 6, -1
        while True:
            ch = q[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        arg = _decimal_round(q[j + 6:comma])
        out.append(q[i:j] + f"round(CAST({arg} AS DECIMAL(38,10)),{q[comma + 1:k]})::DOUBLE")
        i = k + 1


def sql(name: str) -> str:
    return "WITH " + BASE.strip() + "\n" + _decimal_round(FINAL[name])


def all_sql() -> dict[str, str]:
    return {k: sql(k) for k in FINAL}


# ------------------------------------------------------------------ series and models
def _k(keys, prefix=""):
    return "".join(f"{prefix}{k}, " for k in keys)


def _part_by(keys):
    return f"PARTITION BY {', '.join(keys)} " if keys else ""


def gapfill(src: str, keys, measures, fill, index="month", step="month") -> str:
    """fill_gaps over the CTE ``src``: calendar per key from first to last index."""
    on = " AND ".join([f"c.{k} IS NOT DISTINCT FROM s.{k}" for k in keys]
                      + [f"c.{index} = s.{index}"])
    meas = ", ".join((f"coalesce(s.{m}, {fill}) AS {m}" if fill is not None else f"s.{m}")
                     for m in measures)
    if step == "year":
        gen = f"CAST(unnest(generate_series(lo, hi)) AS INTEGER) AS {index}"
    else:
        gen = f"unnest(generate_series(lo, hi, INTERVAL 1 MONTH))::DATE AS {index}"
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    return (f"SELECT {_k(keys, 'c.')}c.{index}, {meas} FROM ("
            f"SELECT {_k(keys)}{gen} FROM (SELECT {_k(keys)}min({index}) AS lo, "
            f"max({index}) AS hi FROM {src} {grp})) c LEFT JOIN {src} s ON {on}")


def classical(src: str, keys, value: str, mult: bool) -> str:
    """Classical decomposition of ``src`` (keys, month, value)."""
    pb = _part_by(keys)
    w = f"({pb}ORDER BY month)"
    w13 = f"({pb}ORDER BY month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)"
    w11 = f"({pb}ORDER BY month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
    det = ("CASE WHEN trend = 0 THEN NULL ELSE y / trend END" if mult else "y - trend")
    fig = ("CASE WHEN avg(f) OVER (" + pb + ") = 0 THEN NULL ELSE f / avg(f) OVER (" + pb + ") END"
           if mult else f"f - avg(f) OVER ({pb})")
    on = " AND ".join([f"d.{k} IS NOT DISTINCT FROM g.{k}" for k in keys] + ["d.pos = g.pos"])
    tr = "CASE WHEN n >= 24 THEN trend END"
    se = "CASE WHEN n >= 24 THEN fig END"
    if mult:
        rem = (f"CASE WHEN ({tr}) * ({se}) = 0 THEN NULL ELSE y / (({tr}) * ({se})) END")
        adj = f"CASE WHEN ({se}) = 0 THEN NULL ELSE y / ({se}) END"
    else:
        rem = f"y - ({tr}) - ({se})"
        adj = f"y - ({se})"
    return f"""
dd AS (
  SELECT *, {det} AS det FROM (
    SELECT {_k(keys)}month, CAST({value} AS DOUBLE) AS y,
           (row_number() OVER {w} - 1) % 12 AS pos, count(*) OVER ({pb}) AS n,
           CASE WHEN count({value}) OVER {w13} = 13
                THEN (sum({value}) OVER {w13} + sum({value}) OVER {w11}) / 24 END AS trend
    FROM {src})),
gg AS (SELECT {_k(keys)}pos, {fig} AS fig FROM (
         SELECT {_k(keys)}pos, avg(det) AS f FROM dd GROUP BY {_k(keys)}pos))
SELECT {_k(keys, 'd.')}month, round(y, 4) AS y, round({tr}, 4) AS trend,
       round({se}, 4) AS seasonal, round({rem}, 4) AS remainder,
       round({adj}, 4) AS season_adjust
FROM dd d LEFT JOIN gg g ON {on}"""


SERIES = f"""
m_rep AS (SELECT month, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price) AS mean_sale
          FROM si_cc GROUP BY month),
c_rep AS (SELECT month, count(*) AS count_sales FROM si_cc GROUP BY month),
p_rep AS (SELECT month, avg(price_sqft) AS mean_pricesqft FROM (
            SELECT month, CASE WHEN sqft = 0 THEN NULL ELSE price / sqft END AS price_sqft
            FROM si_cc) WHERE price_sqft <> 75000 GROUP BY month),
m_region AS (SELECT month, Region, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price)
             AS mean_sale FROM si_viz GROUP BY month, Region),
m_county AS (SELECT month, County, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price)
             AS mean_sale FROM si_cc GROUP BY month, County),
y_county AS (SELECT County, CAST(year(month) AS INTEGER) AS year,
             CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) AS total_sales,
             count(*) AS count_sales FROM si_cc GROUP BY ALL),
m_app AS (SELECT month, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price) AS mean_sale,
          avg(baths) AS mean_baths, avg(beds) AS mean_beds FROM si_app GROUP BY month),
ts_mean AS ({gapfill('m_rep', [], ['mean_sale'], '0.0')}),
ts_count AS ({gapfill('c_rep', [], ['count_sales'], '0')}),
ts_psqft AS ({gapfill('p_rep', [], ['mean_pricesqft'], '0.0')}),
ts_region AS ({gapfill('m_region', ['Region'], ['mean_sale'], '0.0')}),
ts_county AS ({gapfill('m_county', ['County'], ['mean_sale'], '0.0')}),
ts_app AS ({gapfill('m_app', [], ['mean_sale', 'mean_baths', 'mean_beds'], '0.0')}),
tt AS (SELECT month, mean_sale AS y, row_number() OVER (ORDER BY month) AS t FROM ts_mean),
fit AS (
  SELECT n, intercept, slope, sxx, syy, sxy, tbar, last_index,
         greatest(syy - sxy * sxy / sxx, 0.0) AS rss,
         sqrt(greatest(syy - sxy * sxy / sxx, 0.0) / (n - 2)) AS sigma
  FROM (SELECT count(*) AS n, regr_intercept(y, t) AS intercept, regr_slope(y, t) AS slope,
               regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy, regr_sxy(y, t) AS sxy,
               avg(t) AS tbar, max(month) AS last_index FROM tt)),
aug AS (SELECT tt.month, tt.t, tt.y, intercept + slope * t AS fitted,
               tt.y - (intercept + slope * t) AS resid FROM tt, fit)"""

_LL = "(-n / 2.0 * (ln(2 * pi()) + ln(rss / n) + 1))"
_AIC = f"(-2 * {_LL} + 6)"

MODEL_FINAL = {
    "B7": ("", "SELECT month, mean_sale, round(mean_baths, 4) AS mean_baths, "
               "round(mean_beds, 4) AS mean_beds FROM ts_app"),
    "W2": ("", "SELECT Region, month, count(*) AS count FROM si_viz GROUP BY month, Region HAVING count(*) > 1"),
    "W4": ("", "SELECT County, month, mean_sale FROM ts_county"),
    "W5": ("", gapfill("y_county", ["County"], ["total_sales", "count_sales"], None, "year", "year")),
    "W8": ("", "SELECT month, mean_sale, round(mean_baths, 4) AS mean_baths, "
               "round(mean_beds, 4) AS mean_beds, "
               "round(mean_sale - lag(mean_sale, 1) OVER (ORDER BY month), 4) AS mean_sale_d1, "
               "round(mean_sale - lag(mean_sale, 12) OVER (ORDER BY month), 4) AS mean_sale_d12 "
               "FROM ts_app"),
    "W9": ("", "SELECT County, month, mean_sale FROM (SELECT *, max(month) OVER "
               "(PARTITION BY County) AS mx FROM ts_county) WHERE month = mx"),
    "W13": ("", "SELECT month, mean_sale FROM m_rep ORDER BY month LIMIT 5"),
    "W14": ("", "SELECT month, mean_sale FROM m_rep ORDER BY month LIMIT 10 OFFSET 10"),
    "W15": ("", "SELECT count(*) AS n FROM si_app"),
    "M1": ("," + classical("ts_mean", [], "mean_sale", False).split("\nSELECT", 1)[0],
           "SELECT" + classical("ts_mean", [], "mean_sale", False).split("\nSELECT", 1)[1]),
    "M1_count": ("," + classical("ts_count", [], "count_sales", False).split("\nSELECT", 1)[0],
                 "SELECT" + classical("ts_count", [], "count_sales", False).split("\nSELECT", 1)[1]),
    "M1_region": ("," + classical("ts_region", ["Region"], "mean_sale", False).split("\nSELECT", 1)[0],
                  "SELECT" + classical("ts_region", ["Region"], "mean_sale", False).split("\nSELECT", 1)[1]),
    "M2": ("," + classical("ts_mean", [], "mean_sale", True).split("\nSELECT", 1)[0],
           "SELECT" + classical("ts_mean", [], "mean_sale", True).split("\nSELECT", 1)[1]),
    "M2_pricesqft": ("," + classical("ts_psqft", [], "mean_pricesqft", True).split("\nSELECT", 1)[0],
                     "SELECT" + classical("ts_psqft", [], "mean_pricesqft", True).split("\nSELECT", 1)[1]),
    "M5": ("", "SELECT n, round(intercept, 4) AS intercept, round(slope, 4) AS slope, "
               "round(sigma, 4) AS sigma FROM fit"),
    "M18": ("", f"SELECT n, round(intercept, 4) AS intercept, round(slope, 4) AS slope, "
                f"round(sigma * sigma, 4) AS sigma2, round(sxy * sxy / (sxx * syy), 4) AS r2, "
                f"round(1 - (1 - sxy * sxy / (sxx * syy)) * (n - 1) / (n - 2), 4) AS adj_r2, "
                f"round({_LL}, 4) AS loglik, round({_AIC}, 4) AS aic, "
                f"round({_AIC} + 24.0 / (n - 4), 4) AS aicc, "
                f"round(-2 * {_LL} + ln(n) * 3, 4) AS bic FROM fit"),
    "M13": ("", "SELECT (last_index + to_months(CAST(step AS INTEGER)))::DATE AS month, "
                "round(intercept + slope * (n + step), 4) AS mean, "
                "round(sigma * sqrt(1 + 1.0 / n + ((n + step) - tbar) ^ 2 / sxx), 4) AS sigma, "
                "round(intercept + slope * (n + step) - 1.2815515655446004 * sigma * sqrt(1 + 1.0 / n + ((n + step) - tbar) ^ 2 / sxx), 4) AS lo80, "
                "round(intercept + slope * (n + step) + 1.2815515655446004 * sigma * sqrt(1 + 1.0 / n + ((n + step) - tbar) ^ 2 / sxx), 4) AS hi80, "
                "round(intercept + slope * (n + step) - 1.959963984540054 * sigma * sqrt(1 + 1.0 / n + ((n + step) - tbar) ^ 2 / sxx), 4) AS lo95, "
                "round(intercept + slope * (n + step) + 1.959963984540054 * sigma * sqrt(1 + 1.0 / n + ((n + step) - tbar) ^ 2 / sxx), 4) AS hi95 "
                "FROM (SELECT *, unnest(generate_series(1, 10)) AS step FROM fit)"),
    "M16": ("", "SELECT month, round(y, 4) AS y, round(fitted, 4) AS fitted, "
                "round(resid, 4) AS resid FROM aug"),
    "M17": (", r AS (SELECT t, resid - avg(resid) OVER () AS d FROM aug)",
            "SELECT CAST(a.k AS INTEGER) AS lag, round(sum(a.d * b.d) / "
            "(SELECT sum(d * d) FROM r), 4) AS acf FROM "
            "(SELECT r.*, unnest(generate_series(1, 24)) AS k FROM r) a "
            "JOIN r b ON a.t - a.k = b.t GROUP BY a.k"),
    "M17_hist": ("", "SELECT CAST(CASE WHEN hi > lo THEN least(floor((resid - lo) / (hi - lo) * 10) "
                     "+ 1, 10) ELSE 1 END AS INTEGER) AS bin, count(*) AS n FROM "
                     "(SELECT resid, min(resid) OVER () AS lo, max(resid) OVER () AS hi FROM aug) "
                     "GROUP BY ALL"),
}


def sql(name: str) -> str:  # noqa: F811 - extends the base definition
    if name in MODEL_FINAL:
        extra, final = MODEL_FINAL[name]
        return ("WITH RECURSIVE " + BASE.strip() + ",\n" + SERIES.strip() + extra + "\n"
                + _decimal_round(final))
    return "WITH " + BASE.strip() + "\n" + _decimal_round(FINAL[name])


def all_sql() -> dict[str, str]:  # noqa: F811
    return {k: sql(k) for k in [*FINAL, *MODEL_FINAL]}


# ------------------------------------------------------------------ views Q1-Q7
def _trend_fit(src: str, value: str) -> str:
    return f"""SELECT n, intercept, slope, sxx, syy, sxy, tbar, last_index,
         sqrt(greatest(syy - sxy * sxy / sxx, 0.0) / (n - 2)) AS sigma
  FROM (SELECT count(*) AS n, regr_intercept(y, t) AS intercept, regr_slope(y, t) AS slope,
               regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy, regr_sxy(y, t) AS sxy,
               avg(t) AS tbar, max(month) AS last_index
        FROM (SELECT month, {value} AS y, row_number() OVER (ORDER BY month) AS t FROM {src}))"""


def _trend_fc(fit: str, h: int) -> str:
    mean = "(intercept + slope * (n + step))"
    sd = "(sigma * sqrt(1 + 1.0 / n + ((n + step) - tbar) ^ 2 / sxx))"
    return (f"SELECT (last_index + to_months(CAST(step AS INTEGER)))::DATE AS month, "
            f"{mean} AS mean, {sd} AS sigma, "
            f"{mean} - 1.2815515655446004 * {sd} AS lo80, {mean} + 1.2815515655446004 * {sd} AS hi80, "
            f"{mean} - 1.959963984540054 * {sd} AS lo95, {mean} + 1.959963984540054 * {sd} AS hi95 "
            f"FROM (SELECT *, unnest(generate_series(1, {h})) AS step FROM {fit})")


def _dollar(x: str) -> str:
    """Whole dollars unless every value is <= 100,000 and some are not whole."""
    whole = (f"(CASE WHEN round({x}, 0) < 0 THEN '-' ELSE '' END || '$' || "
             f"format('{{:,.0f}}', abs(round({x}, 0))))")
    cents = (f"(CASE WHEN round({x}, 2) < 0 THEN '-' ELSE '' END || '$' || "
             f"format('{{:,.2f}}', abs(round({x}, 2))))")
    rule = (f"(max(abs({x})) OVER () <= 100000 AND "
            f"max(CASE WHEN {x} <> floor({x}) THEN 1 ELSE 0 END) OVER () = 1)")
    return f"(CASE WHEN {rule} THEN {cents} ELSE {whole} END)"


_VIEW = f"""
, options AS ({_OPTIONS}),
q3 AS (SELECT County, TRY_CAST(beds AS INTEGER) AS beds, TRY_CAST(baths AS DOUBLE) AS baths
       FROM options WHERE County = 'NATION_3' AND bdba = '3 beds, 1.5 baths'),
sel AS (SELECT * FROM si_app s WHERE EXISTS (SELECT 1 FROM q3 WHERE q3.County = s.County
        AND q3.beds = s.beds AND q3.baths = s.baths)),
sel_m AS (SELECT month, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price) AS mean_sale
          FROM sel WHERE sqft BETWEEN 1000 AND 5000 GROUP BY month),
sel_ts AS ({gapfill('sel_m', [], ['mean_sale'], '0.0')}),
gfit AS ({_trend_fit('ts_app', 'mean_sale')}),
sfit AS ({_trend_fit('sel_ts', 'mean_sale')}),
last_sale AS (SELECT month AS base_month, mean_sale AS last_sale FROM sel_m
              WHERE month = (SELECT max(month) FROM sel_m))"""

_FC_COLS = ("month, round(mean, 4) AS mean, round(sigma, 4) AS sigma, round(lo80, 4) AS lo80, "
            "round(hi80, 4) AS hi80, round(lo95, 4) AS lo95, round(hi95, 4) AS hi95")

MODEL_FINAL.update({
    "Q1": (_VIEW, "SELECT DISTINCT County FROM options ORDER BY County"),
    "Q2": (_VIEW, "SELECT bdba FROM options WHERE County = 'NATION_3' ORDER BY bdba"),
    "Q3": (_VIEW, "SELECT * FROM q3"),
    "Q4": (_VIEW, "SELECT min(sqft) AS mini, max(sqft) AS maxi FROM sel"),
    "Q5": (_VIEW, f"SELECT month, mean_sale, strftime(month, '%Y %b') AS \"Date\", "
                  f"{_dollar('mean_sale')} AS mean_sale_text FROM sel_m"),
    "Q6_trend": (_VIEW, f"SELECT {_FC_COLS} FROM ({_trend_fc('gfit', 12)})"),
    "Q6_trend_selection": (_VIEW, f"SELECT {_FC_COLS} FROM ({_trend_fc('sfit', 36)})"),
    "Q7_trend": (_VIEW, f"SELECT month, strftime(month, '%Y %b') AS \"Date\", "
                  f"round(mean - last_sale, 4) AS price_diff, "
                  f"{_dollar('mean - last_sale')} AS price_diff_text, "
                  f"round(mean, 4) AS total_sale, {_dollar('mean')} AS total_sale_text, "
                  f"strftime(base_month, '%Y %b') AS base_month "
                  f"FROM ({_trend_fc('gfit', 12)}) f, last_sale"),
})


# ------------------------------------------------------------------ pages E1-E17
_LINKS = ("SELECT page_id, url, CAST(unnest(generate_series(0, len(h) - 1)) AS INTEGER) AS pos, "
          "unnest(h) AS href FROM (SELECT page_id, url, "
          "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages)")
_LISTING = """
, lp AS (
  SELECT o.o_orderkey AS page_id, '/homedetails/' || CAST(p.c_custkey AS VARCHAR) || '_zpid/' AS url,
         CASE WHEN o.o_orderkey % 101 = 7 THEN NULL
              ELSE p.street || ', ' || p.city || ', ' || p.state || ' ' || p.zip END AS address,
         strftime(o.o_orderdate, '%-m/%-d/%Y') AS "Date",
         CASE o.o_orderstatus WHEN 'F' THEN 'Sold' WHEN 'O' THEN 'Listed for sale'
              WHEN 'P' THEN 'Price change' END AS Event,
         '$' || format('{:,.2f}', o.o_totalprice) AS Price,
         CAST(p.c_custkey % 6 AS INTEGER) AS beds,
         CAST(p.c_custkey % 4 AS DOUBLE) * 0.5 + 1.0 AS baths,
         TRY_CAST(regexp_replace(format('{:,.0f}', abs(p.c_acctbal)), '[^0-9]', '', 'g') AS DOUBLE)
           AS sqft, p.street || ', ' || p.city || ', ' || p.state || ' ' || p.zip AS place,
         format('{:,.0f}', abs(p.c_acctbal)) || ' sqft' AS size, '$' || format('{:,.0f}', o.o_totalprice) AS list_price,
         CASE o.o_orderkey % 101 WHEN 7 THEN 'address' WHEN 13 THEN 'beds' WHEN 41 THEN 'sqft' END AS missing
  FROM orders o JOIN props p ON o.o_custkey = p.c_custkey)"""

MODEL_FINAL.update({
    "E1": ("", f"SELECT page_id, pos, href FROM ({_LINKS})"),
    "E2": ("", f"SELECT page_id, pos, href FROM ({_LINKS}) WHERE regexp_matches(href, '/the')"),
    "E3": ("", f"SELECT page_id, pos, href FROM ({_LINKS}) WHERE NOT regexp_matches(href, '/the')"),
    "E4": ("", f"SELECT page_id, pos, href FROM ({_LINKS}) WHERE NOT regexp_matches(href, '/the') "
               f"AND regexp_matches(href, '/[A-Z]')"),
    "E5": ("", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '[0-9]{3}')"),
    "E6": ("", "SELECT '/' || zip || '/' AS href FROM county_zips"),
    "E1_markup": (_LISTING, "SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN '/a/' || k WHEN 1 "
                            "THEN '/b?x=1&y=' || k ELSE '/c/' || k END AS href FROM (SELECT page_id, "
                            "regexp_extract(url, '[0-9]+') AS k, unnest(range(3)) AS pos FROM lp)"),
    "E14_summary": (_LISTING, "SELECT page_id, url AS link, place AS address, list_price, CAST(beds AS VARCHAR) AS beds, "
                              "CAST(baths AS VARCHAR) AS baths, size AS sqft FROM lp"),
    "E7": (_LISTING, "SELECT page_id, url FROM lp WHERE regexp_matches(url, '/homedetails|/home\\-details/')"),
    "E8": ("", f"SELECT page_id, pos, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS link "
               f"FROM ({_LINKS}) WHERE regexp_matches(href, '/the')"),
    "E12": (_LISTING, "SELECT page_id, address, \"Date\", Event, Price FROM lp"),
    "E16": (_LISTING, "SELECT page_id, url AS link, address, beds, baths, sqft FROM lp WHERE missing IS NULL"),
    "E17": (_LISTING, "SELECT page_id, url, missing FROM lp WHERE missing IS NOT NULL"),
})


MODEL_FINAL.update({
    "J4": ("", "SELECT month, Region, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price) "
               "AS mean_sale FROM si_rep s LEFT JOIN county_regions USING (County) "
               "WHERE month IS NOT NULL AND Region IS NOT NULL GROUP BY month, Region "
               "HAVING count(price) = count(*)"),
    "J6": ("", "SELECT month, mean_sale, round(median_sale, 4) AS median_sale FROM "
               "(SELECT month, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price) AS mean_sale "
               "FROM si_viz GROUP BY month) FULL JOIN (SELECT month, median(price) AS median_sale "
               "FROM si_viz GROUP BY month) USING (month)"),
    "J6_region": ("", "SELECT month, Region, measure, CASE WHEN measure = 'mean_sale' THEN price "
                      "ELSE round(price, 4) END AS price FROM (SELECT month, Region, 'mean_sale' "
                      "AS measure, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / count(price) AS price "
                      "FROM si_viz GROUP BY ALL UNION ALL SELECT month, Region, 'median_sale', "
                      "median(price) FROM si_viz GROUP BY ALL)"),
    "J7": ("", "SELECT c.County, z.zip, '/' || lower(c.County) || '-county/' || z.zip AS link "
               "FROM (SELECT DISTINCT County FROM county_zips) c JOIN county_zips z USING (County)"),
    "X4": ("", "SELECT * FROM h EXCEPT ALL SELECT * FROM h WHERE Event = 'Sold'"),
    "S1": ("", "SELECT * FROM h"),
    "U1": ("", "SELECT DISTINCT ts, user_id, event_type, value, props FROM events"),
})
MODEL_FINAL["J8"] = (MODEL_FINAL["E12"][0], "SELECT link FROM info_raw WHERE link NOT IN "
                     "(SELECT url FROM lp WHERE Event = 'Sold')")
MODEL_FINAL["X2"] = (MODEL_FINAL["E12"][0],
                     "SELECT link, address, '$' || format('{:,.0f}', abs(sqft) * 100) AS list_price, "
                     "beds, baths, sqft FROM info_raw UNION ALL SELECT url AS link, address, "
                     "NULL AS list_price, beds, baths, sqft FROM lp WHERE missing IS NULL")


MODEL_FINAL.update({
    "W11": ("", f"SELECT page_id, pos, href, row_number() OVER (ORDER BY md5(href || '#42'), href, page_id, pos) "
                f"AS position FROM ({_LINKS})"),
    "W12": ("", f"SELECT page_id, pos, href FROM (SELECT *, row_number() OVER (PARTITION BY page_id "
                f"ORDER BY md5(CAST(pos AS VARCHAR) || '#42'), pos) AS rn FROM ({_LINKS})) WHERE rn <= 3"),
})


# ------------------------------------------------------------------ Henderson weights (M4)
def _smoothest(terms: int) -> list[float]:
    """The symmetric filter that keeps cubics and whose weights have the least sum of squared
    third differences (zeros outside), from the conditions of the minimum."""
    import numpy as np
    at = np.arange(terms) - terms // 2
    diff = np.diff(np.eye(terms + 6), n=3, axis=0)[:, 3:-3]
    keep = np.array([at ** k for k in range(4)], dtype=float)
    system = np.block([[2 * diff.T @ diff, keep.T], [keep, np.zeros((4, 4))]])
    return list(np.linalg.solve(system, np.r_[np.zeros(terms), 1, 0, 0, 0])[:terms])


def _fanout(zr: str, mode: str) -> str:
    return (f"SELECT count(*) AS rows_in, CAST(sum(coalesce(m, 0)) AS BIGINT) AS rows_out, "
            f"CAST(sum(CASE WHEN coalesce(m, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rows_unmatched, "
            f"round(sum(coalesce(m, 0))::DOUBLE / count(*), 4) AS fanout, '{mode}' AS mode "
            f"FROM (SELECT b.zip FROM h b JOIN i_app i ON b.zip = i.zip AND b.street = i.street "
            f"AND b.city = i.city AND b.state = i.state WHERE b.month IS NOT NULL AND "
            f"b.zip IS NOT NULL AND b.street IS NOT NULL AND b.city IS NOT NULL AND "
            f"b.state IS NOT NULL AND b.Event IS NOT NULL AND b.price IS NOT NULL) x "
            f"LEFT JOIN (SELECT zip, count(*) AS m FROM {zr} GROUP BY zip) z USING (zip)")


MODEL_FINAL["B4_fanout"] = ("", " UNION ALL ".join([
    _fanout("zr_app", "first_zip"), _fanout("zr_viz", "zip_region"), _fanout("zr_all", "all")]))

MODEL_FINAL["U1_stream"] = MODEL_FINAL["U1"]

MODEL_FINAL["B1_rejects"] = ("", "SELECT Event, count(*) AS rows, "
    "CAST(sum(CASE WHEN month IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS bad_date, "
    "CAST(sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS bad_price, "
    "CAST(sum(CASE WHEN zip IS NULL OR state IS NULL OR city IS NULL OR street IS NULL THEN 1 ELSE 0 "
    "END) AS BIGINT) AS bad_address FROM h GROUP BY Event")

MODEL_FINAL["S6"] = ("", "SELECT month, Region, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) / "
                         "count(price) AS mean_sale FROM si_app WHERE year(month) = 1998 "
                         "GROUP BY month, Region")


_LEAF = gapfill("leaf", ["Region", "County"], ["price"], "0.0")
_UP = " UNION ALL ".join(
    f"SELECT {node} AS node, month, round(sum(mean), 4) AS mean FROM ({{fc}}) GROUP BY ALL"
    for node in ("''", "Region", "Region || ' > ' || County"))
_LEAF_FC = """SELECT Region, County, (last_index + to_months(CAST(step AS INTEGER)))::DATE AS month,
  intercept + slope * (n + step) AS mean FROM (SELECT *, unnest(generate_series(1, 5)) AS step FROM (
  SELECT Region, County, count(*) AS n, regr_intercept(price, t) AS intercept, regr_slope(price, t) AS slope,
    max(month) AS last_index FROM (SELECT *, row_number() OVER (PARTITION BY Region, County ORDER BY month) AS t
    FROM leaf_ts) GROUP BY Region, County))"""
MODEL_FINAL["M15"] = (f""",
leaf AS (SELECT month, Region, County, CAST(sum(CAST(price AS DECIMAL(20,2))) AS DOUBLE) AS price FROM si_all
         GROUP BY month, Region, County),
leaf_ts AS ({_LEAF})""", _UP.format(fc=_LEAF_FC))


# ------------------------------------------------------------------ least squares
def _sweep(src: str, keys, y: str, xs: list[str]) -> str:
    """CTEs ``sw`` (keys, n, means, a): centred cross products of xs and y, swept on every
    x in turn, so ``a`` holds the inverse, the slopes (last column) and the residual sum of
    squares (last cell), row by row, counted from 0."""
    cols, p = [*xs, y], len(xs) + 1
    key, by = _k(keys), (f"GROUP BY {', '.join(keys)}" if keys else "")
    centred = ", ".join(f"{c} - avg({c}) OVER ({_part_by(keys)}) AS c{i}" for i, c in enumerate(cols))
    cells = ", ".join(f"sum(c{i} * c{j})" for i in range(p) for j in range(p))
    cell = (f"CASE WHEN r = k AND c = k THEN 1 / a[k * {p} + k + 1] "
            f"WHEN r = k THEN a[k * {p} + c + 1] / a[k * {p} + k + 1] "
            f"WHEN c = k THEN -a[r * {p} + k + 1] / a[k * {p} + k + 1] "
            f"ELSE a[r * {p} + c + 1] - a[r * {p} + k + 1] * a[k * {p} + c + 1] / a[k * {p} + k + 1] END")
    cell = cell.replace("r = k", f"q // {p} = k").replace("c = k", f"q % {p} = k") \
        .replace(f"r * {p}", f"(q // {p}) * {p}").replace("+ c +", f"+ q % {p} +")
    return f"""
gram AS (SELECT {key}count(*) AS n, [{', '.join(f'avg({c})' for c in cols)}] AS means, [{cells}] AS a
         FROM (SELECT {key}{', '.join(cols)}, {centred} FROM {src}) {by}),
steps AS (SELECT {key}n, means, 0 AS k, a FROM gram
          UNION ALL SELECT {key}n, means, k + 1, list_transform(range({p * p}), lambda q: {cell})
          FROM steps WHERE k < {p - 1}),
sw AS (SELECT {key}n, means, a, a[{p * p}] AS rss, a[{p * p}] / (n - {p}) AS sigma2 FROM steps WHERE k = {p - 1}),
syy AS (SELECT {key}a[{p * p}] AS syy FROM gram)"""


def _s7(x: str, name: str) -> str:
    return f"CAST(printf('%.6e', {x}) AS DOUBLE) AS {name}"


def _coefficients(keys, xs: list[str], names: list[str]) -> str:
    p, key = len(xs) + 1, _k(keys)
    slope = [f"a[{i * p + p}]" for i in range(p - 1)]
    intercept = f"means[{p}]" + "".join(f" - {b} * means[{i + 1}]" for i, b in enumerate(slope))
    spread = " + ".join(f"means[{i + 1}] * means[{j + 1}] * a[{i * p + j + 1}]" for i in range(p - 1) for j in range(p - 1))
    rows = [("(Intercept)", intercept, f"sqrt(sigma2 * (1.0 / n + {spread}))")]
    rows += [(n, slope[i], f"sqrt(sigma2 * a[{i * p + i + 1}])") for i, n in enumerate(names)]
    return " UNION ALL ".join(
        f"SELECT {key}'{n}' AS term, {_s7(b, 'estimate')}, {_s7(e, 'std_error')}, "
        f"{_s7(f'({b}) / ({e})', 'statistic')} FROM sw" for n, b, e in rows)


def _fit_stats(p: int) -> dict[str, str]:
    ll = "(-n / 2.0 * (ln(2 * pi()) + ln(rss / n) + 1))"
    aic = f"(-2 * {ll} + {2 * (p + 1)})"
    return {"rss": "rss", "sigma2": "sigma2", "r2": "1 - rss / syy",
            "adj_r2": f"1 - (rss / (n - {p})) / (syy / (n - 1))", "loglik": ll, "aic": aic,
            "aicc": f"{aic} + {2.0 * (p + 1) * (p + 2)} / (n - {p} - 2)", "bic": f"-2 * {ll} + ln(n) * {p + 1}"}


def _report(p: int, *names: str) -> str:
    stats = _fit_stats(p)
    return f"SELECT n, {', '.join(_s7(stats[c], c) for c in names)} FROM sw, syy"


_MEDIANS = f""",
m_med AS (SELECT month, median(sqft) AS median_sqft, median(price) AS median_price, median(baths) AS median_baths,
          median(beds::DOUBLE) AS median_beds FROM si_cc GROUP BY month),
ts_med AS ({gapfill('m_med', [], ['median_sqft', 'median_price', 'median_baths', 'median_beds'], '0.0')}),
md AS (SELECT month, median_price AS y, median_beds AS b, median_baths AS h, median_sqft AS s,
         median_beds * median_baths AS bh, median_beds * median_sqft AS bs, median_baths * median_sqft AS hs FROM ts_med)"""
_BEST = ["s", "bh", "bs"]
_BEST_NAMES = ["median_sqft", "median_beds:median_baths", "median_beds:median_sqft"]
_SEASON = [f"m{k}" for k in range(2, 13)]
_SEASON_SRC = (", tsx AS (SELECT month, mean_sale AS y, CAST(row_number() OVER (ORDER BY month) AS DOUBLE) AS t, "
               + ", ".join(f"CAST(month(month) = {k} AS INTEGER)::DOUBLE AS m{k}" for k in range(2, 13)) + " FROM ts_app)")
_PER_REGION = (", rs AS (SELECT Region, price AS y, sqft AS x1, CAST(beds AS DOUBLE) AS x2, baths AS x3 FROM si_viz)")
_FITTED = ("means[4] - a[4] * means[1] - a[8] * means[2] - a[12] * means[3] + a[4] * s + a[8] * bh + a[12] * bs")
_AUG = f", au AS (SELECT month, y, {_FITTED} AS fitted, y - ({_FITTED}) AS resid FROM md, sw)"

_SUBSETS = ["b", "h", "s", "bh", "bs", "hs"]
_SUBSET_NAMES = ["median_beds", "median_baths", "median_sqft", "median_beds:median_baths",
                 "median_beds:median_sqft", "median_baths:median_sqft"]


def _best_subsets() -> tuple[str, str]:
    """All 63 subsets: eliminating a term from the cross products leaves the partial ones;
    the last cell is the residual sum of squares."""
    cols, p = [*_SUBSETS, "y"], 7
    cells = ", ".join(f"sum(c{i} * c{j})" for i in range(p) for j in range(p))
    centred = ", ".join(f"{c} - avg({c}) OVER () AS c{i}" for i, c in enumerate(cols))
    names = "[" + ", ".join(f"'{n}'" for n in _SUBSET_NAMES) + "]"
    cell = f"a[q + 1] - a[(q // {p}) * {p} + v + 1] * a[v * {p} + q % {p} + 1] / a[v * {p} + v + 1]"
    ctes = f"""{_MEDIANS},
g0 AS (SELECT count(*) AS n, [{cells}] AS a FROM (SELECT {centred} FROM md)),
sub AS (SELECT n, -1 AS top, [0][1:0] AS picked, a, a[{p * p}] AS syy FROM g0
        UNION ALL SELECT n, v, list_append(picked, v), list_transform(range({p * p}), lambda q: {cell}), syy
        FROM (SELECT *, unnest(range(top + 1, {p - 1}))::INTEGER AS v FROM sub)),
r AS (SELECT n, len(picked) AS size, list_transform(picked, lambda i: {names}[i + 1]) AS terms, a[{p * p}] AS rss, syy FROM sub
      WHERE len(picked) > 0),
best AS (SELECT *, (SELECT rss FROM r WHERE size = 6) / (n - 7) AS s2 FROM (
           SELECT *, row_number() OVER (PARTITION BY size ORDER BY rss) AS rn FROM r) WHERE rn = 1)"""
    final = (f"SELECT CAST(size AS INTEGER) AS size, terms, {_s7('rss', 'rss')}, {_s7('1 - rss / syy', 'r2')}, "
             f"{_s7('1 - (rss / (n - size - 1)) / (syy / (n - 1))', 'adj_r2')}, "
             f"{_s7('rss / s2 - n + 2 * (size + 1)', 'cp')}, {_s7('n * ln(rss / n) + ln(n) * (size + 1)', 'bic')} FROM best")
    return ctes, final


_M6 = _SEASON_SRC + "," + _sweep("tsx", [], "y", ["t", *_SEASON])
_M7 = _MEDIANS + "," + _sweep("md", [], "y", _BEST)
MODEL_FINAL.update({
    "M6": (_M6, _coefficients([], ["t", *_SEASON], ["trend()", *[f"season()year{k}" for k in range(2, 13)]])),
    "M7": (_M7, _coefficients([], _BEST, _BEST_NAMES)),
    "M8": (_PER_REGION + "," + _sweep("rs", ["Region"], "y", ["x1", "x2", "x3"]),
           _coefficients(["Region"], ["x1", "x2", "x3"], ["sqft", "beds", "baths"])),
    "M9": _best_subsets(),
    "M10": (_M7, _report(4, "rss", "loglik", "aic", "aicc", "bic")),
    "M18_ols": (_M6, _report(13, "sigma2", "r2", "adj_r2", "loglik", "aic", "aicc", "bic")),
    "M16_ols": (_M7 + _AUG, "SELECT month, round(y, 4) AS y, round(fitted, 4) AS fitted, round(resid, 4) AS resid FROM au"),
    "M17_ols": (_M7 + _AUG + ", rr AS (SELECT row_number() OVER (ORDER BY month) AS t, resid - avg(resid) OVER () AS d FROM au)",
                "SELECT CAST(a.k AS INTEGER) AS lag, round(sum(a.d * b.d) / (SELECT sum(d * d) FROM rr), 4) AS acf FROM "
                "(SELECT rr.*, unnest(generate_series(1, 24)) AS k FROM rr) a JOIN rr b ON a.t - a.k = b.t GROUP BY a.k"),
})
_AHEAD_MEAN = ("means[13] - " + " - ".join(f"a[{i * 13 + 13}] * means[{i + 1}]" for i in range(12)) + " + "
               + " + ".join(f"a[{i * 13 + 13}] * x[{i + 1}]" for i in range(12)))
_AHEAD_VAR = " + ".join(f"(x[{i + 1}] - means[{i + 1}]) * (x[{j + 1}] - means[{j + 1}]) * a[{i * 13 + j + 1}]"
                        for i in range(12) for j in range(12))
MODEL_FINAL["M13_season"] = (_M6 + f""",
ah AS (SELECT *, [n + step, {', '.join(f'CAST(month(ahead) = {k} AS INTEGER)' for k in range(2, 13))}]::DOUBLE[] AS x FROM (
  SELECT *, (last + to_months(CAST(step AS INTEGER)))::DATE AS ahead FROM (
    SELECT sw.*, (SELECT max(month) FROM tsx) AS last, unnest(generate_series(1, 12)) AS step FROM sw))),
fc AS (SELECT ahead AS month, {_AHEAD_MEAN} AS mean, sqrt(sigma2 * (1 + 1.0 / n + {_AHEAD_VAR})) AS sigma FROM ah)""",
    "SELECT month, round(mean, 4) AS mean, round(sigma, 4) AS sigma, "
    + ", ".join(f"round(mean {s} {z} * sigma, 4) AS {c}" for c, s, z in (
        ("lo80", "-", 1.2815515655446004), ("hi80", "+", 1.2815515655446004),
        ("lo95", "-", 1.959963984540054), ("hi95", "+", 1.959963984540054))) + " FROM fc")


MODEL_FINAL.update({
    "S3": ("", "SELECT link FROM info_raw"),
    "S4": ("", "SELECT " + ", ".join(f"CAST(c_custkey * {i + 1} % 1009 AS INTEGER) AS {c}" for i, c in enumerate(
        "ID Price Sqft Bedroom Bathroom Airconditioning Garage Pool YearBuild Quality Lot AdjHighway".split()))
        + " FROM customer"),
    "S5": ("", 'SELECT month, CAST("Index" AS DOUBLE) AS "Index" FROM cpi'),
    "S9": ("", "SELECT link, address, beds, baths, sqft FROM info_raw"),
    "P5": ("", "SELECT County, Region AS Area FROM county_regions"),
    "F11": ("", "SELECT b AS beds, (SELECT count(*) FROM si_app WHERE County = 'NATION_3' AND beds = b) AS n_sales, "
                "(SELECT count(*) FROM si_app WHERE County = 'NATION_3' AND beds = b) > 0 AS has_sales "
                "FROM (SELECT unnest([3, 0])::INTEGER AS b)"),
    "U1_replay": ("", "SELECT DISTINCT CASE WHEN user_id % 7 <> 0 THEN ts END AS ts, user_id, event_type, value, props FROM events"),
})

MODEL_FINAL["U1_state"] = MODEL_FINAL["U1_replay"]

from . import oracle_series  # noqa: E402

MODEL_FINAL.update(oracle_series.QUERIES)
