"""SQL for DuckDB that gives the same rows as the queries of the same name."""

from __future__ import annotations

import re

LAGS = range(31)

FEATURES = ["goods_num", "goods_price", "orginal_shop_price", "shop_price", "promote_price",
            "goods_click", "cart_click", "favorites_click", "sales_uv", "onsale_days"]


def _week(day: str) -> str:
    return f"CAST((date_diff('day', {day}, DATE '2001-11-05') - 1) // 7 AS INTEGER)"


def _mean(col: str) -> str:
    return f"CAST(sum(CAST(round({col} * 100) AS BIGINT)) AS DOUBLE) / 100e0 / count({col})"


# ---- common table expressions, in the order in which they build on each other

LINES = """lines AS (
  SELECT CAST(l_shipdate AS DATE) AS data_date, p_brand AS goods_id,
         CAST(l_suppkey AS VARCHAR) AS supplier, CAST(l_partkey AS VARCHAR) AS sku_id,
         l_quantity AS goods_num, l_extendedprice AS goods_price,
         p_retailprice AS orginal_shop_price, l_discount
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _sales(name: str, goods: str) -> str:
    return f"""{name} AS (
  SELECT {goods} AS goods_id, sku_id, {_week('data_date')} AS "weekNum",
         sum(goods_num) AS goods_num, {_mean('goods_price')} AS goods_price,
         {_mean('orginal_shop_price')} AS orginal_shop_price
  FROM lines GROUP BY 1, 2, 3)"""


SALES = _sales("sales", "goods_id")
SUPPLIER_SALES = _sales("supplier_sales", "supplier")

DAILY = """daily AS (
  SELECT CAST(ts AS DATE) - 8164 AS data_date,
         'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS goods_id,
         count(*) FILTER (WHERE event_type = 'click') AS goods_click,
         count(*) FILTER (WHERE event_type = 'view') AS cart_click,
         count(*) FILTER (WHERE event_type = 'signup') AS favorites_click,
         count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS sales_uv,
         count(DISTINCT event_type) AS onsale_days
  FROM events GROUP BY 1, 2)"""

TRAFFIC = f"""traffic AS (
  SELECT {_week('data_date')} AS "weekNum", goods_id,
         avg(goods_click) AS goods_click, avg(cart_click) AS cart_click,
         avg(favorites_click) AS favorites_click, avg(sales_uv) AS sales_uv,
         avg(onsale_days) AS onsale_days
  FROM daily GROUP BY 1, 2)"""

PRICES = f"""prices AS (
  SELECT {_week('data_date')} AS "weekNum", goods_id,
         {_mean('orginal_shop_price')} AS shop_price, {_mean('goods_price')} AS promote_price
  FROM lines WHERE l_discount > 0 GROUP BY 1, 2)"""

JOINED = """joined AS (
  SELECT s."weekNum", s.goods_id, s.sku_id, goods_num, goods_price, orginal_shop_price,
         shop_price, promote_price, goods_click, cart_click, favorites_click, sales_uv,
         onsale_days
  FROM sales s LEFT JOIN prices p ON s."weekNum" = p."weekNum" AND s.goods_id = p.goods_id
               LEFT JOIN traffic t ON s."weekNum" = t."weekNum" AND s.goods_id = t.goods_id)"""

FILLED = "ft AS (SELECT \"weekNum\", goods_id, sku_id, " + ", ".join(
    f"coalesce({c}, 0.0) AS {c}" for c in FEATURES) + " FROM joined)"

BASE = [LINES, SALES, DAILY, TRAFFIC, PRICES, JOINED, FILLED]


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _table(select: str) -> str:
    return _with(*BASE) + select


def _history(name: str, source: str) -> str:
    return f'{name} AS (SELECT *, 61 - "weekNum" AS "weekNum2" FROM {source})'


def _cells(source: str, sku: str, week: str, cols: dict[str, str]) -> str:
    """One row per SKU and slot 1..55, zeros where the source has no row."""
    out = ", ".join(f'CAST(coalesce(h.{expr}, 0) AS DOUBLE) AS "v_{name}"'
                    for name, expr in cols.items())
    return f"""SELECT s.{sku}, CAST(w.slot AS INTEGER) AS {week}, {out}
FROM (SELECT DISTINCT {sku} FROM {source}) s
CROSS JOIN (SELECT unnest(range(1, 56)) AS slot) w
LEFT JOIN {source} h ON h.{sku} = s.{sku} AND h.slot_key = w.slot"""


def _last_goods(name: str, source: str) -> str:
    """Per SKU and week the row of the highest goods id."""
    return f"""{name} AS (
  SELECT *, "weekNum2" AS slot_key FROM {source}
  QUALIFY row_number() OVER (PARTITION BY sku_id, "weekNum2" ORDER BY goods_id DESC) = 1)"""


def _lag_select(source: str, target: int, extra: str = "", joins: str = "") -> str:
    """Running sums over the lags, added in lag order.

    Each lag column is the one before plus the value of its week.
    """
    values = ", ".join(
        f'coalesce(max({c}) FILTER (WHERE "weekNum2" = {target - k}), 0.0) AS v_{c}_{k}'
        for k in LAGS for c in ("goods_num", "goods_price"))
    chain = ", ".join(
        (f"v_{c}_0 AS {c}_0" if k == 0 else f"{c}_{k - 1} + v_{c}_{k} AS {c}_{k}")
        for k in LAGS for c in ("goods_num", "goods_price"))
    return f"""SELECT id, {chain}{extra}
FROM (SELECT sku_id AS id, {values} FROM {source} GROUP BY sku_id) v {joins}"""


IN_TRAIN = """(CAST('0x' || substr(md5(sku_id || '|' || "weekNum2"), 1, 8) AS BIGINT) % 1000 < 800)"""

SALES_HISTORY = [LINES, SALES, _history("h", "sales")]
SUPPLIER_HISTORY = [LINES, SUPPLIER_SALES, _history("h", "supplier_sales")]

SUBMITTED = """SELECT "weekNum", {what} FROM {sales} JOIN part
ON sku_id = CAST(p_partkey AS VARCHAR) GROUP BY 1 ORDER BY 1 DESC"""


def _yoy(source: str, weeks: str, cols: list[str]) -> str:
    """Rows of week w + 53 with the units of week w, for the label weeks given."""
    return f"""SELECT f.sku_id, f.goods_id, {", ".join("f." + c for c in cols)},
       coalesce(label, 0.0) AS label
FROM {source} f LEFT JOIN (
  SELECT sku_id, "weekNum" + 53 AS label_for, sum(goods_num) AS label FROM {source}
  WHERE "weekNum" {weeks} GROUP BY 1, 2) l
ON f.sku_id = l.sku_id AND f."weekNum" = l.label_for
WHERE f."weekNum" - 53 {weeks}"""


def _target_rows(masked: bool, source: str, width: int) -> str:
    """Facts of the target rows; `one` is unique per SKU and week, `h` is not."""
    own = ("CASE WHEN h.\"weekNum2\" BETWEEN 1 AND 55 THEN 0.0 END" if masked else
           "CASE WHEN h.\"weekNum2\" BETWEEN 1 AND 55 THEN o.goods_num END")
    minus = "CASE WHEN h.\"weekNum2\" BETWEEN 1 AND 55 THEN o.goods_num ELSE 0 END"
    one_less = "CASE WHEN h.\"weekNum2\" BETWEEN 1 AND 55 AND o.goods_num <> 0 THEN 1 ELSE 0 END"
    total = f"coalesce(t.units, 0.0) - {minus}" if masked else "coalesce(t.units, 0.0)"
    weeks = f"coalesce(t.n, 0) - {one_less}" if masked else "coalesce(t.n, 0)"
    return f"""SELECT h.sku_id, h."weekNum2", h.goods_num, {own} AS own_units,
       CAST({total} AS DOUBLE) AS all_units, CAST({weeks} AS INTEGER) AS sold_weeks,
       {width} AS width
FROM {source} h
JOIN one o ON h.sku_id = o.sku_id AND h."weekNum2" = o."weekNum2"
LEFT JOIN (SELECT sku_id, sum(goods_num) AS units,
                  count(*) FILTER (WHERE goods_num <> 0) AS n
           FROM one WHERE "weekNum2" BETWEEN 1 AND 55 GROUP BY 1) t ON h.sku_id = t.sku_id"""


# One feature, L2-regularised on standardised columns: the usual slope divided by
# 1 + reg / standard deviation of the label.
ONE_FEATURE = """pairs AS (
  SELECT s.id, coalesce(l.label, 0.0) AS y, s.past AS x
  FROM (SELECT sku_id AS id, coalesce(sum(goods_num) FILTER
               (WHERE "weekNum2" BETWEEN 3 AND 33), 0.0) AS past FROM h GROUP BY 1) s
  LEFT JOIN (SELECT sku_id AS id, sum(goods_num) AS label FROM h
             WHERE "weekNum2" = 40 GROUP BY 1) l ON s.id = l.id)"""

LINEAR = _with(*SALES_HISTORY, ONE_FEATURE, """line AS (
  SELECT regr_slope(y, x) / (1 + 0.1 / stddev_pop(y)) AS slope, avg(y) AS my, avg(x) AS mx
  FROM pairs)""") + """SELECT id, y AS goods_num,
       round(my + slope * (x - mx), 6) AS prediction FROM pairs, line"""

CROSS_VALIDATION = _with(*SALES_HISTORY, ONE_FEATURE, """
folded AS (SELECT *, CAST(id AS BIGINT) % 4 AS fold FROM pairs),
fits AS (
  SELECT g.reg, k.fold, regr_slope(y, x) / (1 + g.reg / stddev_pop(y)) AS slope,
         avg(y) AS my, avg(x) AS mx
  FROM folded f JOIN (SELECT DISTINCT fold FROM folded) k ON f.fold <> k.fold
  CROSS JOIN (VALUES (0.1e0), (0.01e0)) g(reg) GROUP BY 1, 2),
errors AS (
  SELECT reg, t.fold, sqrt(avg(pow(y - (my + slope * (x - mx)), 2))) AS rmse
  FROM fits t JOIN folded f ON f.fold = t.fold GROUP BY 1, 2)""") + """
SELECT reg, round(avg(rmse), 6) AS rmse FROM errors GROUP BY 1"""

YOY_LINE = _with(LINES, SALES, "pairs AS (" + _yoy("sales", "BETWEEN 0 AND 303", ["goods_num"])
                 + """),
line AS (
  SELECT regr_slope(label, goods_num) / (1 + 0.1 / stddev_pop(label)) AS slope,
         avg(label) AS my, avg(goods_num) AS mx FROM pairs),
guess AS (
  SELECT sku_id, "weekNum", my + slope * (goods_num - mx) AS p FROM sales, line
  WHERE "weekNum" BETWEEN 48 AND 52),
wide AS (SELECT sku_id, """ + ", ".join(
    f'round(avg(p) FILTER (WHERE "weekNum" = {53 - k}), 6) AS week{k}' for k in range(1, 6))
                 + " FROM guess GROUP BY 1)") + """SELECT CAST(p_partkey AS VARCHAR) AS sku_id,
       week1, week2, week3, week4, week5
FROM part LEFT JOIN wide ON CAST(p_partkey AS VARCHAR) = sku_id"""

# Two features with an L2 term: the normal equations of the standardised columns,
# with c the correlations and reg / standard deviation of the label on the diagonal.
FORECAST = _with(*SALES_HISTORY, """past AS (
  SELECT sku_id, coalesce(sum(goods_num) FILTER (WHERE "weekNum2" BETWEEN 3 AND 33), 0.0) AS x
  FROM h GROUP BY 1),
rows AS (SELECT x, "weekNum2" AS w, goods_num AS y FROM h JOIN past USING (sku_id)),
moments AS (
  SELECT corr(x, w) AS cxw, corr(x, y) AS cxy, corr(w, y) AS cwy, stddev_pop(x) AS sx,
         stddev_pop(w) AS sw, stddev_pop(y) AS sy, avg(x) AS mx, avg(w) AS mw, avg(y) AS my,
         1 + 0.1 / stddev_pop(y) AS d FROM rows),
line AS (
  SELECT (d * cxy - cxw * cwy) / (d * d - cxw * cxw) * sy / sx AS bx,
         (d * cwy - cxw * cxy) / (d * d - cxw * cxw) * sy / sw AS bw, mx, mw, my FROM moments),
asked AS (
  SELECT CAST(p_partkey AS VARCHAR) AS sku_id, p_partkey IN (SELECT l_partkey FROM lineitem
         WHERE """ + _week('CAST(l_shipdate AS DATE)') + """ BETWEEN 6 AND 60) AS has_history
  FROM part)""") + "SELECT a.sku_id, " + ", ".join(
    f"""CAST(trunc(my + bx * ((CASE WHEN has_history THEN x ELSE 0 END) - mx)
         + bw * ({61 + k} - mw) + 0.5) AS {{kind}}) AS week{k}""" for k in range(1, 6)) + """{flag}
FROM asked a LEFT JOIN past p ON a.sku_id = p.sku_id CROSS JOIN line"""

# Ridge regression with any number of inputs and labels: the normal equations of the standardised
# columns, solved by Gauss-Jordan elimination. `source` holds one row per observation, weighted
# by `n`, with the lists x (inputs) and y (labels).
def _solved(source: str, reg: float, weight: str = "1", gram: str | None = None,
            prefix: str = "") -> list[str]:
    """CTEs up to `fits(label, betas, intercept)`, their names with a prefix.

    `gram(i, j, v)` may be given ready-made. A column that never changes gets 0.
    """
    cells = gram or f"""SELECT i, j, sum({weight} * z[i] * z[j]) AS v
  FROM (SELECT *, unnest(range(1, len(z) + 1)) AS j FROM (
    SELECT *, unnest(range(1, len(z) + 1)) AS i FROM (
      SELECT *, [1e0] || x || y AS z FROM {source}))) GROUP BY 1, 2"""
    found = [f"cells AS ({cells})", f"""sizes AS (
  SELECT max(i) AS width, (SELECT max(len(y)) FROM {source}) AS labels,
         (SELECT v FROM cells WHERE i = 1 AND j = 1) AS n FROM cells),
means AS (SELECT j AS i, v / n AS m FROM cells, sizes WHERE i = 1),
spread AS (
  SELECT c.i, c.j, v / n - a.m * b.m AS v FROM cells c, sizes, means a, means b
  WHERE a.i = c.i AND b.i = c.j),
scale AS (SELECT i, CASE WHEN v <= 1e-18 * m * m THEN 1 ELSE sqrt(v) END AS s
          FROM spread JOIN means USING (i) WHERE i = j),
targets_ AS (SELECT width - labels + k AS pos, k FROM sizes, (SELECT unnest(range(1, 100)) AS k)
           WHERE k <= labels),
systems AS (
  SELECT k, pos, list(line ORDER BY i) AS m FROM (
    SELECT k, pos, c.i, list(CASE WHEN c.j = pos THEN c.v / a.s / b.s
             ELSE c.v / a.s / b.s + CASE WHEN c.i = c.j THEN {reg}e0 / t.s ELSE 0 END END
             ORDER BY c.j) AS line
    FROM spread c, targets_, sizes, scale a, scale b, scale t
    WHERE a.i = c.i AND b.i = c.j AND t.i = pos AND c.i > 1 AND c.i <= width - labels
      AND c.j > 1 AND (c.j <= width - labels OR c.j = pos) GROUP BY 1, 2, 3) GROUP BY 1, 2),
steps AS (
  SELECT k, pos, 0 AS done, m FROM systems UNION ALL
  SELECT k, pos, done + 1, list_transform(range(1, len(m) + 1), lambda i:
    CASE WHEN i = done + 1 THEN list_transform(m[i], lambda x: x / m[done + 1][done + 1])
    ELSE list_transform(range(1, len(m) + 2), lambda j:
           m[i][j] - m[i][done + 1] / m[done + 1][done + 1] * m[done + 1][j]) END)
  FROM steps WHERE done < len(m)),
weights_ AS (
  SELECT k, t.pos, u.i, m[u.i - 1][len(m) + 1] * y.s / x.s AS beta
  FROM steps t, (SELECT unnest(range(2, 1000)) AS i) u, scale x, scale y
  WHERE done = len(m) AND u.i <= len(m) + 1 AND x.i = u.i AND y.i = t.pos),
fits AS (
  SELECT k AS label, list(beta ORDER BY b.i) AS betas,
         any_value(y.m) - sum(beta * x.m) AS intercept
  FROM weights_ b, means x, means y WHERE x.i = b.i AND y.i = b.pos GROUP BY 1)"""]
    names = r"\b(cells|sizes|means|spread|scale|targets_|systems|steps|weights_|fits)\b"
    return [re.sub(names, prefix + r"\1", part) for part in found]


# One row per SKU: the matrix row x, and the sums of its label rows. The cells of the Gram matrix
# follow from those: 1 and x weighted by the number of rows, week and label by their sums.
FACTORISED = _with("RECURSIVE_MARK", *SALES_HISTORY, """one AS (
  SELECT sku_id, "weekNum2" AS w, goods_num FROM h
  QUALIFY row_number() OVER (PARTITION BY sku_id, "weekNum2" ORDER BY goods_id DESC) = 1),
skus AS (
  SELECT sku_id, count(*) AS n, sum("weekNum2") AS sw, sum(goods_num) AS sy,
         sum("weekNum2" * "weekNum2") AS sww, sum("weekNum2" * goods_num) AS swy,
         sum(goods_num * goods_num) AS syy FROM h GROUP BY 1),
parts AS (
  SELECT sku_id, 1 AS i, 1e0 AS x FROM skus UNION ALL
  SELECT sku_id, 1 + w, goods_num FROM one WHERE w BETWEEN 1 AND 55),
known AS (SELECT [0e0] AS y),
half AS (
  SELECT a.i, b.i AS j, sum(n * a.x * b.x) AS v FROM skus JOIN parts a USING (sku_id)
  JOIN parts b USING (sku_id) GROUP BY 1, 2 UNION ALL
  SELECT i, 57, sum(x * sw) FROM skus JOIN parts USING (sku_id) GROUP BY i UNION ALL
  SELECT 57, i, sum(x * sw) FROM skus JOIN parts USING (sku_id) GROUP BY i UNION ALL
  SELECT i, 58, sum(x * sy) FROM skus JOIN parts USING (sku_id) GROUP BY i UNION ALL
  SELECT 58, i, sum(x * sy) FROM skus JOIN parts USING (sku_id) GROUP BY i UNION ALL
  SELECT 57, 57, sum(sww) FROM skus UNION ALL SELECT 57, 58, sum(swy) FROM skus UNION ALL
  SELECT 58, 57, sum(swy) FROM skus UNION ALL SELECT 58, 58, sum(syy) FROM skus)""", *_solved(
    "known", 0.1, gram="""SELECT i, j, coalesce(v, 0) AS v
  FROM (SELECT unnest(range(1, 59)) AS i) CROSS JOIN (SELECT unnest(range(1, 59)) AS j)
  LEFT JOIN half USING (i, j)""")) + """
SELECT CASE k WHEN 56 THEN 'target_week' ELSE 'week_' || k END AS name,
       round(betas[k], 6) AS coefficient
FROM fits, (SELECT unnest(range(1, 57)) AS k) UNION ALL
SELECT 'intercept', round(intercept, 6) FROM fits"""

YOY = _with("RECURSIVE_MARK", *BASE, "rows AS (SELECT [" + ", ".join(FEATURES) + """] AS x,
         [label] AS y FROM (""" + _yoy("ft", "IN (6, 7)", FEATURES) + "))", *_solved("rows", 0.1),
            "guess AS (SELECT sku_id, \"weekNum\", intercept + list_dot_product([" + ", ".join(
                f"CAST({c} AS DOUBLE)" for c in FEATURES) + """], betas) AS p FROM ft, fits
  WHERE "weekNum" BETWEEN 48 AND 52),
wide AS (SELECT sku_id, """ + ", ".join(
    f'round(avg(p) FILTER (WHERE "weekNum" = {53 - k}), 6) AS week{k}' for k in range(1, 6))
            + " FROM guess GROUP BY 1)") + """SELECT CAST(p_partkey AS VARCHAR) AS sku_id,
       week1, week2, week3, week4, week5
FROM part LEFT JOIN wide ON CAST(p_partkey AS VARCHAR) = sku_id"""


def _trailing_fit(regs: tuple[float, ...] = (0.1, 0.01), folds: int = 4) -> str:
    """Each penalty scored by folds dealt by SKU number, the better one fitted on the training part."""
    lags = ", ".join(f"{c}_{k}" for k in LAGS for c in ("goods_num", "goods_price"))
    parts = [f"""rows AS MATERIALIZED (
  SELECT id, [{lags}] AS x, [goods_num] AS y, CAST(id AS BIGINT) % {folds} AS fold,
         CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % 1000 < 800 AS train
  FROM (""" + _lag_select("h", 33, ", coalesce(label, 0.0) AS goods_num",
                          """LEFT JOIN (SELECT sku_id, sum(goods_num) AS label FROM h
             WHERE "weekNum2" = 40 GROUP BY 1) l ON v.id = l.sku_id""") + "))"]
    scores = []
    for r, reg in enumerate(regs):
        for fold in range(folds):
            name = f"r{r}f{fold}_"
            parts.append(f"{name}rows AS (SELECT * FROM rows WHERE train AND fold <> {fold})")
            parts += _solved(f"{name}rows", reg, prefix=name)
            scores.append(f"""SELECT {r} AS r, sqrt(avg(pow(y[1] - intercept
                - list_dot_product(x, betas), 2))) AS e
                FROM rows, {name}fits WHERE train AND fold = {fold}""")
        parts.append(f"all{r}_rows AS (SELECT * FROM rows WHERE train)")
        parts += _solved(f"all{r}_rows", reg, prefix=f"all{r}_")
    parts.append("scores AS (" + " UNION ALL ".join(scores) + ")")
    parts.append("best AS (SELECT r FROM scores GROUP BY 1 ORDER BY avg(e), r LIMIT 1)")
    every = " UNION ALL ".join(f"SELECT {r} AS r, * FROM all{r}_fits" for r in range(len(regs)))
    return _with("RECURSIVE_MARK", *SALES_HISTORY, *parts) + f"""SELECT id, y[1] AS goods_num,
       round(intercept + list_dot_product(x, betas), 6) AS prediction
FROM rows, (SELECT f.* FROM ({every}) f JOIN best USING (r))"""


DIRECT_WEEKS = """weeks AS (
  SELECT sku_id, "weekNum2" AS w, goods_num FROM h WHERE "weekNum2" BETWEEN 1 AND 55
  QUALIFY row_number() OVER (PARTITION BY sku_id, "weekNum2" ORDER BY goods_id DESC) = 1)"""


def _past(lag: int, target: str) -> str:
    return f"coalesce(sum(b.goods_num) FILTER (b.w BETWEEN {target} - {lag} AND {target}), 0)"


DIRECT = _with("RECURSIVE_MARK", *SALES_HISTORY, DIRECT_WEEKS, f"""rows AS (
  SELECT a.sku_id, a.w, [{", ".join(_past(k, "a.w") for k in (0, 3, 12, 30))}] AS x,
         [{", ".join(f"coalesce(sum(b.goods_num) FILTER (b.w = a.w + {k}), 0)"
                     for k in range(6, 11))}] AS y
  FROM weeks a JOIN weeks b USING (sku_id) WHERE a.w <= 45 GROUP BY 1, 2),
last AS (
  SELECT s.sku_id, [{", ".join(_past(k, "55") for k in (0, 3, 12, 30))}] AS x
  FROM (SELECT DISTINCT sku_id FROM h) s LEFT JOIN weeks b USING (sku_id) GROUP BY 1)""",
               *_solved("rows", 0.1)) + "SELECT a.sku_id, " + ", ".join(
    f"""round((SELECT intercept FROM fits WHERE label = {k}) + coalesce(list_dot_product(x,
       (SELECT betas FROM fits WHERE label = {k})), 0), 6) AS week{k}""" for k in range(1, 6)) + """,
       l.sku_id IS NOT NULL AS has_history
FROM (SELECT CAST(p_partkey AS VARCHAR) AS sku_id FROM part) a LEFT JOIN last l USING (sku_id)"""

ORIGINS = _with(*SALES_HISTORY, DIRECT_WEEKS, f"""rows AS (
  SELECT a.sku_id, a.w + 7 AS week, {_past(30, "a.w")} AS x,
         coalesce(sum(b.goods_num) FILTER (b.w = a.w + 7), 0) AS y
  FROM weeks a JOIN weeks b USING (sku_id) WHERE a.w <= 48 GROUP BY 1, 2),
origins AS (SELECT unnest(range(20, (SELECT max(week) FROM rows), 4)) AS origin),
fits AS (
  SELECT origin, reg, count(*) AS n, regr_slope(y, x) / (1 + reg / stddev_pop(y)) AS slope,
         avg(x) AS mx, avg(y) AS my
  FROM origins JOIN rows ON week <= origin CROSS JOIN (VALUES (1e0), (0.1e0), (0.01e0)) g(reg)
  GROUP BY 1, 2)""") + """
SELECT CAST(origin AS INTEGER) AS origin, reg, any_value(n) AS train_rows, count(*) AS test_rows,
       round(sqrt(avg(pow(y - my - slope * (x - mx), 2))), 6) AS rmse
FROM fits JOIN rows ON week > origin AND week <= origin + 4 GROUP BY 1, 2"""

# Boosted stumps on two inputs with few values: every split between two values is tried.
def _stumps(rounds: int, step: float | list[float], leaf_reg: float, held: str,
            base: str | None = None) -> list[str]:
    """CTEs b0, b1, ...: the rows with `made_k`, their prediction after round k."""
    steps = step if isinstance(step, list) else [step] * rounds
    out = [f"""b0 AS MATERIALIZED (
  SELECT sku_id, "weekNum2", goods_num AS y, (("weekNum2" % 13) + 13) % 13 AS f1,
         CAST(floor(orginal_shop_price / 100) AS INTEGER) AS f2, {held} AS held,
         {base or f"(SELECT avg(goods_num) FROM h WHERE NOT ({held}))"} AS made_0 FROM h)"""]
    for k in range(1, rounds + 1):
        rest = f"y - made_{k - 1}"
        out.append(f"""s{k} AS MATERIALIZED (
  SELECT f, v, count(*) AS n, sum(rest) AS s FROM (
    SELECT 1 AS f, f1 AS v, {rest} AS rest FROM b{k - 1} WHERE NOT held UNION ALL
    SELECT 2, f2, {rest} FROM b{k - 1} WHERE NOT held) GROUP BY 1, 2),
c{k} AS (
  SELECT f, v, sum(n) OVER upto AS nl, sum(s) OVER upto AS sl, sum(n) OVER (PARTITION BY f) AS n,
         sum(s) OVER (PARTITION BY f) AS s FROM s{k}
  WINDOW upto AS (PARTITION BY f ORDER BY v)),
t{k} AS MATERIALIZED (
  SELECT f, v, sl / (nl + {leaf_reg}) AS low, (s - sl) / (n - nl + {leaf_reg}) AS high FROM c{k}
  WHERE nl < n ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, f, v LIMIT 1),
b{k} AS MATERIALIZED (
  SELECT b.*, made_{k - 1} + {steps[k - 1]} * CASE WHEN (CASE f WHEN 1 THEN f1 ELSE f2 END) <= v THEN low
         ELSE high END AS made_{k} FROM b{k - 1} b, t{k})""")
    return out


def _rmse(k: int, held: str) -> str:
    return f"sqrt(avg(pow(y - made_{k}, 2)) FILTER ({held}))"


RIDGE_LEAVES = _with(*SALES_HISTORY, *_stumps(4, 0.5, 2.0, "false")) + """
SELECT sku_id, "weekNum2", round(made_4, 6) AS prediction FROM b4"""

# Spark's trees: the first one is the first prediction, later ones are fitted to twice the residuals.
STUMPS = _with(*SALES_HISTORY, *_stumps(4, [1.0, 0.4, 0.4, 0.4], 0.0, f"NOT {IN_TRAIN}", "0e0")) + """
SELECT sku_id, "weekNum2", round(made_4, 6) AS prediction FROM b4"""

HISTORY = _with(*SALES_HISTORY, *_stumps(4, 0.5, 2.0, f"NOT {IN_TRAIN}")) + " UNION ALL ".join(
    f"""SELECT {k} AS round, round({_rmse(k, "NOT held")}, 6) AS train_rmse,
       round({_rmse(k, "held")}, 6) AS valid_rmse FROM b4""" for k in range(1, 5))

EARLY_STOP = _with(*SALES_HISTORY, *_stumps(5, 1.4, 2.0, f"NOT {IN_TRAIN}"), "errors AS (" +
                   " UNION ALL ".join(f"SELECT {k} AS k, {_rmse(k, 'held')} AS e FROM b5"
                                      for k in range(1, 6)) + ")", """
best AS (SELECT k FROM errors ORDER BY e, k LIMIT 1)""") + """
SELECT sku_id, "weekNum2", round([made_1, made_2, made_3, made_4, made_5][k], 6) AS prediction,
       k AS trees FROM b5, best WHERE held"""

# One stump on categories: bins in the order of their means, every cut of that order is tried.
MISSING = _table("").rstrip() + """,
bounds AS (SELECT list_sort(list_distinct(quantile_disc(goods_click, [""" + ", ".join(
    repr(k / 6) for k in range(1, 6)) + """]))) AS b FROM ft WHERE goods_click <> 0),
binned AS (SELECT goods_num, CASE WHEN goods_click = 0 THEN 0 ELSE
             1 + len(list_filter(b, lambda x: goods_click > x)) END AS bin FROM ft, bounds),
stats AS (SELECT bin, count(*) AS n, sum(goods_num) AS s FROM binned GROUP BY 1),
cuts AS (
  SELECT bin, s / n AS mean, sum(n) OVER upto AS nl, sum(s) OVER upto AS sl,
         sum(n) OVER () AS n, sum(s) OVER () AS s
  FROM stats WINDOW upto AS (ORDER BY s / n, bin)),
best AS (SELECT mean, sl / (nl + 2) AS low, (s - sl) / (n - nl + 2) AS high FROM cuts WHERE nl < n
         ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC LIMIT 1)
SELECT CAST(bin AS INTEGER) AS bin, t.n AS rows,
       CASE WHEN t.s / t.n <= mean THEN 'left' ELSE 'right' END AS side,
       round(CASE WHEN t.s / t.n <= mean THEN low ELSE high END, 6) AS prediction
FROM stats t, best"""

CHI = _table("").rstrip() + """,
flags AS (
  SELECT CAST(goods_num >= 30 AS INTEGER) AS y, [CAST(orginal_shop_price >= 1000 AS INTEGER),
         CAST(goods_click > 0 AS INTEGER), CAST(goods_price >= 50000 AS INTEGER)] AS f FROM ft),
long AS (SELECT y, f[i] AS v, i FROM flags CROSS JOIN (SELECT unnest([1, 2, 3]) AS i) n),
counts AS (SELECT i, y, v, count(*) AS n FROM long GROUP BY 1, 2, 3),
sums AS (
  SELECT a.i, a.y, b.v, a.n * b.n * 1e0 / (SELECT count(*) FROM ft) AS expected
  FROM (SELECT i, y, sum(n) AS n FROM counts GROUP BY 1, 2) a
  JOIN (SELECT i, v, sum(n) AS n FROM counts GROUP BY 1, 2) b ON a.i = b.i),
chi AS (
  SELECT s.i, sum(pow(coalesce(c.n, 0) - expected, 2) / expected) AS stat
  FROM sums s LEFT JOIN counts c ON s.i = c.i AND s.y = c.y AND s.v = c.v GROUP BY 1)
SELECT CAST(y AS DOUBLE) AS label, CAST(v AS DOUBLE) AS selected, count(*) AS count
FROM long WHERE i = (SELECT i FROM chi ORDER BY stat DESC, i LIMIT 1) GROUP BY 1, 2"""

PRICE_MAP = """one AS (SELECT sku_id AS id, "weekNum2" AS target, goods_num, goods_price FROM h),
maps AS (SELECT id, map_from_entries(list((target, goods_price))) AS m FROM one GROUP BY 1)"""


def _all_targets() -> str:
    units = ", ".join(f"sum(goods_num) OVER (PARTITION BY one.id ORDER BY target RANGE BETWEEN "
                      f"{k} PRECEDING AND CURRENT ROW) AS goods_num_{k}" for k in LAGS)
    price = ", ".join(
        f"{f'goods_price_{k - 1} + ' if k else ''}coalesce(m[target - {k}], 0.0) "
        f"AS goods_price_{k}" for k in LAGS)
    return _with(*SALES_HISTORY, PRICE_MAP) + (
        f"SELECT one.id, target, {units}, {price} FROM one JOIN maps ON one.id = maps.id")


NO_WEEK = "SELECT sku_id, goods_id, " + ", ".join(FEATURES) + ' FROM ft WHERE "weekNum" = 7'
ALL_COLUMNS = 'SELECT "weekNum", goods_id, sku_id, ' + ", ".join(FEATURES) + " FROM ft"

ORACLES: dict[str, str] = {
    "week_bucket": f"""SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey,
        CAST(l_linenumber AS VARCHAR) AS l_linenumber,
        strftime(l_shipdate, '%Y%m%d') AS data_date,
        {_week('CAST(l_shipdate AS DATE)')} AS "weekNum" FROM lineitem""",
    "week_bucket_floor": """SELECT o_orderkey, CAST(floor((date_diff('day',
        CAST(o_orderdate AS DATE), DATE '2001-11-05') - 1) / 7e0) AS INTEGER) AS "weekNum"
        FROM orders""",
    "typed_projection": """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey,
        CAST(l_linenumber AS VARCHAR) AS l_linenumber,
        CAST(trunc(l_quantity) AS INTEGER) AS l_quantity, CAST(trunc(l_tax) AS INTEGER) AS l_tax,
        l_extendedprice,
        CASE WHEN l_returnflag <> 'R' THEN CAST(trunc(l_extendedprice) AS INTEGER) END AS l_whole,
        CASE WHEN l_returnflag <> 'R' THEN l_discount END AS l_share
        FROM lineitem""",
    "reverse_week": _with(*SALES_HISTORY) + 'SELECT sku_id, "weekNum2", goods_num FROM h',
    "round_half_up": """SELECT l_orderkey, l_linenumber, l_partkey,
        CAST(trunc((l_extendedprice - 50000) / 1000 + 0.5) AS INTEGER) AS rounded
        FROM lineitem""",
    "weekly_sales": _with(LINES, SALES) + """SELECT goods_id, sku_id, "weekNum", goods_num,
        goods_price, orginal_shop_price FROM sales""",
    "weekly_traffic": _with(DAILY, TRAFFIC) + "SELECT * FROM traffic",
    "weekly_prices": _with(LINES, PRICES) + "SELECT * FROM prices",
    "weekly_sales_continued": _with(LINES, SALES) + """SELECT goods_id, sku_id, "weekNum",
        goods_num, goods_price, orginal_shop_price FROM sales""",
    "weekly_prices_continued": _with(LINES, PRICES) + "SELECT * FROM prices",
    "weekly_traffic_continued": _with(DAILY, TRAFFIC) + "SELECT * FROM traffic",
    "rows_per_week": _with(LINES) + f"""SELECT {_week('data_date')} AS "weekNum",
        count(*) AS count FROM lines GROUP BY 1 ORDER BY 1""",
    "newest_weeks_preview": _with(LINES) + f"""SELECT {_week('data_date')} AS "weekNum",
        count(*) AS count FROM lines GROUP BY 1 ORDER BY 1 LIMIT 100""",
    "submit_units_per_week": _with(LINES, SALES) + SUBMITTED.format(
        what="sum(goods_num) AS units", sales="sales"),
    "submit_skus_per_week": _with(LINES, SUPPLIER_SALES) + SUBMITTED.format(
        what="count(*) AS count", sales="supplier_sales"),
    "sku_count": "SELECT count(*) AS count FROM (SELECT DISTINCT p_partkey FROM part)",
    "goods_fanout": "SELECT p_brand AS goods_id, count(*) AS count FROM part GROUP BY 1",
    "feature_table": _table(ALL_COLUMNS),
    "feature_row_count": _table("SELECT count(*) AS count FROM ft"),
    "week_snapshot": _table(NO_WEEK),
    "week_snapshot_unfilled": _table(ALL_COLUMNS.replace("FROM ft", "FROM joined")
                                     + ' WHERE "weekNum" = 12'),
    "yoy_training_set": _table(_yoy("ft", "IN (6, 7)", FEATURES)),
    "yoy_training_set_all_weeks": _table(_yoy("ft", "BETWEEN 0 AND 303", FEATURES)),
    "yoy_stacked": _table(_yoy("ft", "= 6", FEATURES) + "\nUNION ALL\n"
                          + _yoy("ft", "= 7", FEATURES)),
    "yoy_several_goods": _with(LINES, SUPPLIER_SALES) + _yoy(
        "supplier_sales", "BETWEEN 0 AND 303", FEATURES[:3]),
    "dense_week_matrix": _table("").rstrip() + ",\n" + ",\n".join(
        [_history("h0", "ft"), _last_goods("h", "h0")]) + "\n" + _cells(
            "h", "sku_id", "week", {"weekNum2": '"weekNum2"', **{c: c for c in FEATURES}}),
    "dense_week_matrix_several_goods": _with(
        *SUPPLIER_HISTORY, _last_goods("one", "h")) + _cells(
            "one", "sku_id", "week", {"weekNum2": '"weekNum2"', "goods_num": "goods_num",
                                      "goods_price": "goods_price"}),
    "sales_week_matrix_summed": _with(*SUPPLIER_HISTORY, """one AS (
        SELECT sku_id, "weekNum2" AS slot_key, sum(goods_num) AS goods_num FROM h
        GROUP BY 1, 2)""") + _cells("one", "sku_id", "week", {"goods_num": "goods_num"}),
    "value_keyed_vector": _with(*SALES_HISTORY, """one AS (
        SELECT sku_id, CAST(trunc(goods_num) AS INTEGER) AS slot_key, goods_num FROM h
        QUALIFY row_number() OVER (PARTITION BY sku_id, trunc(goods_num)
                                   ORDER BY "weekNum2" DESC, goods_id DESC) = 1)""")
    + _cells("one", "sku_id", "slot", {"goods_num": "goods_num"}),
    "trailing_sums": _with(*SALES_HISTORY) + _lag_select("h", 33),
    "trailing_sums_checked": _with(*SALES_HISTORY) + _lag_select("h", 33),
    "bad_offsets": """SELECT CAST(p_partkey AS VARCHAR) AS sku_id, CAST(k AS INTEGER) AS horizon,
        CAST(61 + k + CASE WHEN p_partkey % 3 = 2 THEN 2 ELSE 0 END AS INTEGER) AS "weekNum"
        FROM part CROSS JOIN (SELECT unnest(range(1, 6)) AS k) h""",
    "holdout_split": _with(*SALES_HISTORY) + f"""SELECT sku_id, "weekNum2", goods_num,
        CASE WHEN {IN_TRAIN} THEN 'train' ELSE 'test' END AS side FROM h""",
    "holdout_score": _with(*SALES_HISTORY) + f"""SELECT round(1 / (1 + sqrt(avg(
        pow(goods_num - (SELECT avg(goods_num) FROM h WHERE {IN_TRAIN}), 2)))), 9) AS score
        FROM h WHERE NOT {IN_TRAIN}""",
    "trailing_sums_stage": _with(*SALES_HISTORY) + _lag_select("h", 33),
    "week_matrix_stage": _with(*SALES_HISTORY, _last_goods("one", "h")) + _cells(
        "one", "sku_id", "week", {"goods_num": "goods_num", "goods_price": "goods_price"}),
    "trailing_sums_several_goods": _with(
        *SUPPLIER_HISTORY, _last_goods("one", "h")) + _lag_select("one", 50),
    "trailing_sums_all_targets": _all_targets(),
    "extract_label": _with(*SALES_HISTORY) + """SELECT sku_id AS id, goods_num FROM h
        WHERE "weekNum2" = 40""",
    "horizon_training_set": _with(*SALES_HISTORY) + _lag_select(
        "h", 33, ", coalesce(label, 0.0) AS goods_num",
        """LEFT JOIN (SELECT sku_id, sum(goods_num) AS label FROM h WHERE "weekNum2" = 40
           GROUP BY 1) l ON v.id = l.sku_id"""),
    "target_week_rows": _with(*SALES_HISTORY, _last_goods("one", "h")) + _target_rows(
        False, "h", 605),
    "target_week_rows_masked": _with(*SUPPLIER_HISTORY, _last_goods("one", "h")) + _target_rows(
        True, "h", 165),
    "assembled_features": _table('SELECT sku_id, "weekNum", ' + ", ".join(
        f"{c} AS f_{c}" for c in FEATURES) + " FROM ft"),
    "poly_expand": _with(*SALES_HISTORY) + """SELECT sku_id, "weekNum2", goods_num AS p0,
        goods_num * goods_num AS p1, CAST("weekNum2" AS DOUBLE) AS p2,
        goods_num * "weekNum2" AS p3, CAST("weekNum2" AS DOUBLE) * "weekNum2" AS p4 FROM h""",
    "poly_sparse": _with(*SALES_HISTORY) + """SELECT sku_id, "weekNum2", goods_num AS p0,
        goods_num * goods_num AS p1, CAST("weekNum2" AS DOUBLE) AS p2,
        goods_num * "weekNum2" AS p3, CAST("weekNum2" AS DOUBLE) * "weekNum2" AS p4 FROM h""",
    "chi_select": CHI,
    "linear_fit": LINEAR,
    "model_roundtrip": LINEAR,
    "cv_fit": CROSS_VALIDATION,
    "linear_fit_factorised": FACTORISED.replace("WITH RECURSIVE_MARK,", "WITH RECURSIVE"),
    "cv_one_pass": CROSS_VALIDATION,
    "yoy_forecast": YOY.replace("WITH RECURSIVE_MARK,", "WITH RECURSIVE"),
    "trailing_fit": _trailing_fit().replace("WITH RECURSIVE_MARK,", "WITH RECURSIVE"),
    "features_roundtrip": _table(ALL_COLUMNS),
    "local_rows": _with(LINES, SALES) + """SELECT "weekNum", kind, count(*) AS sold,
        sum(goods_num) AS units FROM sales JOIN (VALUES (6, 'spring'), (7, 'spring'), (59, 'autumn'))
        AS named("week", kind) ON "weekNum" = "week" GROUP BY 1, 2""",
    "origin_scores": ORIGINS,
    "forecast_direct": DIRECT.replace("WITH RECURSIVE_MARK,", "WITH RECURSIVE"),
    "gbt_stumps": STUMPS,
    "gbt_ridge_leaves": RIDGE_LEAVES,
    "gbt_missing": MISSING,
    "training_history": HISTORY,
    "early_stop": EARLY_STOP,
    "score_metric": _with(*SALES_HISTORY) + """SELECT round(1 / (1 + sqrt(avg(
        pow(goods_num - abs("weekNum2" % 50), 2)))), 9) AS score FROM h""",
    "forecast_grid": f"""SELECT CAST(p_partkey AS VARCHAR) AS sku_id, CAST(k AS INTEGER) AS horizon,
        CAST(61 + k AS INTEGER) AS "weekNum", p_partkey IN (SELECT l_partkey FROM lineitem
        WHERE {_week('CAST(l_shipdate AS DATE)')} BETWEEN 6 AND 60) AS has_history
        FROM part CROSS JOIN (SELECT unnest(range(1, 6)) AS k) h""",
    "target_weeks": "SELECT CAST(p_partkey AS VARCHAR) AS sku_id, " + ", ".join(
        f"{61 + k} AS target{k}" for k in range(1, 6)) + " FROM part",
    "forecast_coverage": f"""WITH sold AS (SELECT DISTINCT l_partkey FROM lineitem
        WHERE {_week('CAST(l_shipdate AS DATE)')} = 52)
        SELECT count(*) FILTER (WHERE l_partkey IS NULL) AS missing,
               count(l_partkey) AS matched
        FROM part LEFT JOIN sold ON p_partkey = l_partkey""",
    "yoy_forecast_units": YOY_LINE,
    "forecast_linear": FORECAST.format(kind="INTEGER", flag=", has_history"),
    "forecast_file": FORECAST.format(kind="INTEGER", flag="").replace(
        "CAST(trunc(", "CAST(CAST(trunc(").replace("AS INTEGER) AS week",
                                                   "AS INTEGER) AS VARCHAR) AS week"),
    "csv_roundtrip": _table(ALL_COLUMNS),
    "week_folders_roundtrip": _table(ALL_COLUMNS + ' WHERE "weekNum" BETWEEN 48 AND 52'),
    "matrix_roundtrip": _with(*SALES_HISTORY, _last_goods("one", "h")) + _cells(
        "one", "sku_id", "week", {"goods_num": "goods_num"}),
}
