"""DuckDB SQL that repeats the queries on the same tables.

The SQL shares common table expressions. Series have the key column ``k`` inside and its table name outside.
"""

from __future__ import annotations

from growthpanel.functions import noise
from growthpanel.operators.averaging import BY_MSE, BY_R2, SIMPLE


def _weeks(name: str, source: str, scale: str = "{}") -> str:
    """Weekly sums with their running total for rows (k, d, v)."""
    total = scale.format("SUM(v)")
    running = scale.format("SUM(number) OVER (PARTITION BY k ORDER BY date)")
    return f"""
{name}_sums AS (SELECT k, d + CAST(7 - isodow(d) AS INTEGER) AS date, COALESCE({total}, 0) AS number FROM {source} GROUP BY 1, 2),
{name}_weeks AS (SELECT k, date, number, {running} AS cumulative FROM {name}_sums)"""


def _calendar(name: str) -> str:
    """All weeks of each series, filled as the library does."""
    return f"""
{name}_calendar AS (
  SELECT k, CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 7 DAY)) AS DATE) AS date FROM {name}_weeks GROUP BY k),
{name}_gaps AS (
  SELECT c.k, c.date, COALESCE(w.number, 0) AS number, w.cumulative
  FROM {name}_calendar c LEFT JOIN {name}_weeks w ON w.k = c.k AND w.date = c.date),
{name}_rolled AS (
  SELECT *, ROW_NUMBER() OVER s - 1 AS pos, datediff('day', MIN(date) OVER (PARTITION BY k), date) / 7.0 AS x,
    CASE WHEN COUNT(number) OVER r4 = 4 THEN AVG(number) OVER r4 END AS m4,
    CASE WHEN COUNT(number) OVER r12 = 12 THEN AVG(number) OVER r12 END AS m12
  FROM {name}_gaps
  WINDOW s AS (PARTITION BY k ORDER BY date), r4 AS (PARTITION BY k ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
    r12 AS (PARTITION BY k ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
{name}_weekly AS (
  SELECT k, date, number, pos, x,
    COALESCE(LAST_VALUE(cumulative IGNORE NULLS) OVER b, FIRST_VALUE(cumulative IGNORE NULLS) OVER a) AS cumulative,
    COALESCE(LAST_VALUE(m4 IGNORE NULLS) OVER b, FIRST_VALUE(m4 IGNORE NULLS) OVER a) AS m4,
    COALESCE(LAST_VALUE(m12 IGNORE NULLS) OVER b, FIRST_VALUE(m12 IGNORE NULLS) OVER a) AS m12
  FROM {name}_rolled
  WINDOW b AS (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    a AS (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{name}_target AS (
  SELECT k, date, pos, x, MAX(cumulative) OVER (PARTITION BY k ORDER BY pos) AS y FROM {name}_weekly)"""


def _folds(name: str) -> str:
    """Fold count rule for five splits and a gap of four weeks."""
    return f"""
{name}_n AS (SELECT k, CAST(COUNT(*) AS INTEGER) AS n FROM {name}_target GROUP BY k),
{name}_k1 AS (SELECT *, CASE WHEN n >= 52 THEN 5 WHEN n < 10 THEN 2 WHEN 5 > n // 4 AND n // 4 > 1 THEN GREATEST(2, n // 4) ELSE 5 END AS k1 FROM {name}_n),
{name}_k2 AS (SELECT *, CASE WHEN k1 >= n THEN GREATEST(2, n - 1) ELSE k1 END AS k2, GREATEST(2, n // 4 - 1) AS fewer FROM {name}_k1),
{name}_k3 AS (SELECT *, CASE WHEN n // (k2 + 1) < 4 AND k2 > 2 THEN CASE WHEN fewer >= n THEN GREATEST(2, n - 1) ELSE fewer END ELSE k2 END AS splits FROM {name}_k2),
{name}_plan AS (
  SELECT k, n, CAST(splits AS INTEGER) AS splits, CAST(n // (splits + 1) AS INTEGER) AS block,
    CASE WHEN splits < n AND n - 4 - splits * (n // (splits + 1)) > 0 THEN 'ok' ELSE 'too_few_rows' END AS status FROM {name}_k3),
{name}_folds AS (
  SELECT k, n, splits, CAST(fold AS INTEGER) AS fold, CAST(n - (splits - fold) * block - 4 AS INTEGER) AS train_end,
    CAST(n - (splits - fold) * block AS INTEGER) AS test_start, CAST(n - (splits - fold) * block + block AS INTEGER) AS test_end
  FROM (SELECT *, unnest(range(splits)) AS fold FROM {name}_plan WHERE status = 'ok')),
{name}_roles AS (
  SELECT * FROM (SELECT t.*, f.fold, f.splits, f.train_end, f.test_start, f.test_end,
    CASE WHEN pos < train_end THEN 'train' WHEN pos >= test_start AND pos < test_end THEN 'test' END AS role
    FROM {name}_target t JOIN {name}_folds f ON f.k = t.k) WHERE role IS NOT NULL)"""


# start shapes, and the bounded linear pair of each fold and of the whole series (fold -1)
_FIT = """
facts AS (SELECT k, MAX(y) AS ymax, MIN(y) AS ymin, MIN(x) AS xlo, MAX(x) AS xhi, MEDIAN(x) AS xmid, COUNT(*) AS n FROM flag_target GROUP BY k),
models AS (SELECT * FROM (VALUES ('Exponential', 0), ('Logistic', 1), ('Richards', 2), ('Gompertz', 3)) AS m(model, place)),
shaped AS (
  SELECT t.k, t.pos, t.x, t.y, m.model, m.place, f.ymax, f.xmid,
    CASE model WHEN 'Exponential' THEN exp(0.005 * x) WHEN 'Gompertz' THEN exp(-exp(-0.01 * (x - xmid)))
      WHEN 'Richards' THEN pow(1 + exp(-0.02 * (x - xmid)), -1 / 0.5) ELSE 1 / (1 + exp(-0.01 * (x - xmid))) END AS u
  FROM flag_target t JOIN facts f ON f.k = t.k CROSS JOIN models m),
ranges AS (SELECT k, fold, train_end FROM flag_folds UNION ALL SELECT k, -1, n FROM facts),
sums AS (
  SELECT s.k, s.model, s.place, r.fold, s.ymax, s.xmid, COUNT(*) AS n, SUM(u) AS su, SUM(u * u) AS suu, SUM(y) AS sy, SUM(u * y) AS suy
  FROM shaped s JOIN ranges r ON r.k = s.k AND s.pos < r.train_end GROUP BY ALL),
slopes AS (SELECT *, (suy - su * sy / n) / (suu - su * su / n) AS slope, CASE WHEN model = 'Exponential' THEN 0 ELSE ymax END AS low FROM sums),
heights AS (SELECT *, CASE WHEN model = 'Gompertz' THEN (sy - slope * su) / n + slope ELSE slope END AS wanted FROM slopes),
held AS (SELECT *, LEAST(GREATEST(wanted, low), 2 * ymax) AS height FROM heights),
offsets AS (
  SELECT *, CASE WHEN model <> 'Gompertz' THEN (sy - height * su) / n WHEN height = wanted THEN height - slope
    ELSE ((sy - suy) - height * (su - suu)) / (n - 2 * su + suu) END AS alpha FROM held),
params AS (
  SELECT k, model, place, fold, height, alpha, xmid, CASE WHEN model = 'Gompertz' THEN height - alpha ELSE height END AS beta,
    CASE model WHEN 'Exponential' THEN [height, 0.005::DOUBLE, alpha] WHEN 'Logistic' THEN [height, 0.01::DOUBLE, xmid, alpha]
      WHEN 'Richards' THEN [height, 0.02::DOUBLE, xmid, 0.5::DOUBLE, alpha] ELSE [height, 0.01::DOUBLE, xmid, alpha] END AS params
  FROM offsets)"""

_SCORE = """SQRT(AVG((y - pred) * (y - pred))) AS rmse,
    CASE WHEN COUNT(pred) < 2 THEN NULL ELSE 1 - SUM((y - pred) * (y - pred)) / REGR_SYY(y, y) END AS r2,
    AVG(ABS(y - pred)) AS mae, COUNT(pred) AS n"""

_MODELS = f"""
curve_preds AS (SELECT s.k, s.pos, s.x, s.y, s.model, s.place, p.alpha + p.beta * s.u AS pred FROM shaped s JOIN params p ON p.k = s.k AND p.model = s.model AND p.fold = -1),
fold_preds AS (
  SELECT r.k, r.fold, r.role, r.pos, r.y, s.model, s.place, p.alpha + p.beta * s.u AS pred
  FROM flag_roles r JOIN shaped s ON s.k = r.k AND s.pos = r.pos JOIN params p ON p.k = r.k AND p.model = s.model AND p.fold = r.fold),
fold_metrics AS (SELECT k, model, place, fold, role, {_SCORE} FROM fold_preds GROUP BY ALL),
curve_metrics AS (
  SELECT k, model, place, CAST(COUNT(*) FILTER (role = 'test') AS INTEGER) AS folds,
    AVG(rmse) FILTER (role = 'test') AS test_rmse, STDDEV_POP(rmse) FILTER (role = 'test') AS test_rmse_std,
    AVG(mae) FILTER (role = 'test') AS test_mae, STDDEV_POP(mae) FILTER (role = 'test') AS test_mae_std,
    AVG(r2) FILTER (role = 'test') AS test_r2, AVG(rmse) FILTER (role = 'train') AS train_rmse
  FROM fold_metrics GROUP BY ALL),
last_fold AS (SELECT k, MAX(fold) AS fold FROM flag_folds GROUP BY k),
parts AS (SELECT p.* FROM params p JOIN last_fold l ON l.k = p.k AND l.fold = p.fold),
weighing AS (SELECT m.k, m.model, m.place, m.r2, m.rmse * m.rmse AS mse FROM fold_metrics m JOIN last_fold l ON l.k = m.k AND l.fold = m.fold WHERE role = 'test'),
softened AS (SELECT *, EXP(r2 - MAX(r2) OVER (PARTITION BY k)) AS soft, 1 / (mse + 1e-9) AS inverse FROM weighing),
weights AS (SELECT *, soft / SUM(soft) OVER (PARTITION BY k) AS r2_weight, inverse / SUM(inverse) OVER (PARTITION BY k) AS inv_mse_weight FROM softened),
part_preds AS (SELECT s.k, s.pos, s.x, s.y, s.model, p.alpha + p.beta * s.u AS pred FROM shaped s JOIN parts p ON p.k = s.k AND p.model = s.model),
averaged AS (
  SELECT s.k, s.pos, s.x, s.y, AVG(pred) AS simple, SUM(r2_weight * pred) / SUM(r2_weight) AS by_r2, SUM(inv_mse_weight * pred) / SUM(inv_mse_weight) AS by_mse
  FROM part_preds s JOIN weights w ON w.k = s.k AND w.model = s.model GROUP BY ALL),
average_preds AS (
  SELECT k, pos, x, y, '{SIMPLE}' AS model, 10 AS place, simple AS pred FROM averaged
  UNION ALL SELECT k, pos, x, y, '{BY_R2}', 11, by_r2 FROM averaged UNION ALL SELECT k, pos, x, y, '{BY_MSE}', 12, by_mse FROM averaged),
average_metrics AS (SELECT k, model, place, {_SCORE} FROM average_preds GROUP BY ALL),
metrics AS (
  SELECT k, model, place, 'Individual' AS type, 'test_folds' AS scope, test_rmse AS rmse, test_r2 AS r2, test_mae AS mae FROM curve_metrics
  UNION ALL SELECT k, model, place, 'Ensemble', 'full_in_sample', rmse, r2, mae FROM average_metrics),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k, type ORDER BY r2 DESC, place) AS place_in_type FROM metrics),
best AS (SELECT k, type, model AS best_model, r2 AS best_score FROM ranked WHERE place_in_type = 1),
scaled AS (
  SELECT *, (rmse - MIN(rmse) OVER s) / (MAX(rmse) OVER s - MIN(rmse) OVER s + 1e-10) AS a, (r2 - MIN(r2) OVER s) / (MAX(r2) OVER s - MIN(r2) OVER s + 1e-10) AS b,
    (mae - MIN(mae) OVER s) / (MAX(mae) OVER s - MIN(mae) OVER s + 1e-10) AS c FROM metrics WINDOW s AS (PARTITION BY k)),
overall AS (SELECT *, (1 - a + b + 1 - c) / 3 AS overall_score FROM scaled),
long_metrics AS (
  SELECT k, model, 'rmse' AS metric, rmse AS score FROM metrics UNION ALL SELECT k, model, 'r2', r2 FROM metrics UNION ALL SELECT k, model, 'mae', mae FROM metrics),
ends AS (SELECT k, MAX(date) AS last_date, MAX(x) AS last_x, MAX(pos) AS last_pos FROM flag_target GROUP BY k),
future AS (SELECT k, CAST(last_date + CAST(7 * i AS INTEGER) AS DATE) AS date, CAST(last_pos + i AS INTEGER) AS pos, last_x + i AS x FROM ends CROSS JOIN (SELECT unnest(range(1, 261)) AS i)),
future_shape AS (
  SELECT f.*, m.model, CASE m.model WHEN 'Exponential' THEN exp(0.005 * x) WHEN 'Gompertz' THEN exp(-exp(-0.01 * (x - xmid))) WHEN 'Richards' THEN pow(1 + exp(-0.02 * (x - xmid)), -1 / 0.5) ELSE 1 / (1 + exp(-0.01 * (x - xmid))) END AS u
  FROM future f JOIN facts USING (k) CROSS JOIN models m),
future_curve AS (
  SELECT s.k, s.date, s.pos, s.x, s.model, p.alpha + p.beta * s.u AS pred FROM future_shape s
  JOIN best b ON b.k = s.k AND b.type = 'Individual' AND b.best_model = s.model JOIN params p ON p.k = s.k AND p.model = s.model AND p.fold = -1),
future_parts AS (SELECT s.k, s.pos, s.model, p.alpha + p.beta * s.u AS pred FROM future_shape s JOIN parts p ON p.k = s.k AND p.model = s.model),
future_average AS (
  SELECT s.k, s.pos, AVG(pred) AS simple, SUM(r2_weight * pred) / SUM(r2_weight) AS by_r2, SUM(inv_mse_weight * pred) / SUM(inv_mse_weight) AS by_mse
  FROM future_parts s JOIN weights w ON w.k = s.k AND w.model = s.model GROUP BY ALL),
future_ensemble AS (
  SELECT a.k, a.pos, b.best_model AS model, CASE b.best_model WHEN '{SIMPLE}' THEN simple WHEN '{BY_R2}' THEN by_r2 ELSE by_mse END AS pred
  FROM future_average a JOIN best b ON b.k = a.k AND b.type = 'Ensemble'),
flag_split AS (
  SELECT t.k, t.date, t.pos, t.x, t.y, COALESCE(r.role, 'none') AS split FROM flag_target t
  LEFT JOIN (SELECT * FROM flag_roles WHERE fold = splits - 1) r ON r.k = t.k AND r.pos = t.pos),
resid AS (SELECT *, y - pred AS residual FROM curve_preds)"""

_LINEITEM = "SELECT {} AS k, CAST(l_shipdate AS DATE) AS d, l_quantity AS v FROM lineitem"
_SOURCES = f"""
flag_rows AS ({_LINEITEM.format("l_returnflag")}),{_weeks("flag", "flag_rows")},{_calendar("flag")},{_folds("flag")},
supp_rows AS ({_LINEITEM.format("l_suppkey")}),{_weeks("supp", "supp_rows")},{_calendar("supp")},
cust_rows AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v FROM orders),
{_weeks("cust", "cust_rows", "ROUND({}, 2)")},{_calendar("cust")},{_folds("cust")},
segment_rows AS (SELECT c_mktsegment AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
{_weeks("segment", "segment_rows", "ROUND({}, 2)")},{_calendar("segment")}"""

_WITH = f"WITH {_SOURCES},{_FIT},{_MODELS}\n"


def _r(value: str, name: str, digits: int = 2) -> str:
    """Rounded double; adding 0 turns -0 into 0."""
    return f"ROUND(CAST({value} AS DOUBLE), {digits}) + 0 AS {name}"


def _day(column: str = "date") -> str:
    return f"strftime({column}, '%Y-%m-%d') AS {column}"


_K = "k AS l_returnflag"
_I = "CAST(pos AS INTEGER) AS pos"
_QUOTED = {"rmse": '"RMSE"', "r2": '"R²"', "mae": '"MAE"'}


def _wide(models: list[str], source: str, digits: int = 2) -> str:
    columns = ", ".join(_r(f"MAX(CASE WHEN model = '{m}' THEN pred END)", f'"{m}_Pred"', digits) for m in models)
    return f"SELECT {_K}, x AS \"Day\", {{extra}}{columns} FROM {source} GROUP BY k, x"


_CURVES = ["Exponential", "Logistic", "Richards", "Gompertz"]
_AVERAGES = [SIMPLE, BY_R2, BY_MSE]
_BOTH = "(SELECT k, pos, x, y, model, pred FROM curve_preds UNION ALL SELECT k, pos, x, y, model, pred FROM average_preds)"


def _quantile_sql() -> str:
    """The normal quantile of p by the same published coefficients."""

    def poly(x: str, values: tuple[float, ...]) -> str:
        text = repr(values[0]) + "::DOUBLE"
        for v in values[1:]:
            text = f"({text} * {x} + ({v!r}::DOUBLE))"
        return text

    centre = f"(p - 0.5) * {poly('((p - 0.5) * (p - 0.5))', noise._CENTRE_TOP)} / {poly('((p - 0.5) * (p - 0.5))', noise._CENTRE_BOTTOM)}"
    depth = "SQRT(-2 * LN(LEAST(p, 1 - p)))"
    tail = f"{poly(depth, noise._TAIL_TOP)} / {poly(depth, noise._TAIL_BOTTOM)}"
    edge = noise._TAIL_STARTS
    return f"CASE WHEN p < {edge} THEN {tail} WHEN p > 1 - {edge} THEN -({tail}) ELSE {centre} END"


_BOX = f"""
SELECT {_K}, year, {_r("q1", "q1", 4)}, {_r("median", "median", 4)}, {_r("q3", "q3", 4)},
  {_r("MIN(CASE WHEN inside THEN number END)", "low_whisker", 4)}, {_r("MAX(CASE WHEN inside THEN number END)", "high_whisker", 4)},
  COUNT(*) FILTER (NOT inside) AS outliers
FROM (SELECT w.*, b.*, number BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM (SELECT *, CAST(YEAR(date) AS INTEGER) AS year FROM flag_weekly) w
  JOIN (SELECT k AS bk, CAST(YEAR(date) AS INTEGER) AS b_year, QUANTILE_CONT(number, 0.25) AS q1, QUANTILE_CONT(number, 0.5) AS median, QUANTILE_CONT(number, 0.75) AS q3
    FROM flag_weekly GROUP BY 1, 2) b ON b.bk = w.k AND b.b_year = w.year)
GROUP BY k, year, q1, median, q3"""

_BINS = """
bin_facts AS (
  SELECT k, model, COUNT(*) AS n, MIN(residual) AS low, MAX(residual) AS high, STDDEV_SAMP(residual) AS std,
    (MAX(residual) - MIN(residual)) / (LOG2(COUNT(*)) + 1) AS sturges,
    2 * (QUANTILE_CONT(residual, 0.75) - QUANTILE_CONT(residual, 0.25)) / CBRT(COUNT(*)) AS diaconis FROM resid GROUP BY k, model),
bins AS (
  SELECT *, (high - low) / bins AS width FROM (SELECT *, CAST(CEIL((high - low) / CASE WHEN diaconis > 0 THEN LEAST(diaconis, sturges) ELSE sturges END) AS INTEGER) AS bins FROM bin_facts))"""

_TABLES: dict[str, str] = {
    "s4_write_tables": f"SELECT {_K}, {_day()}, {_r('number', 'number', 4)}, {_r('cumulative', 'cumulative', 4)}, {_r('m4', 'rolling_mean_4w', 4)}, {_r('m12', 'rolling_mean_12w', 4)}, CAST(MONTH(date) AS INTEGER) AS month, CAST(QUARTER(date) AS INTEGER) AS quarter, {_r('x', 'time_idx', 4)}, {_I} FROM flag_weekly",
    "flagship_weekly_by_segment": f"SELECT k AS c_mktsegment, {_day()}, {_r('number', 'number', 4)}, {_r('cumulative', 'cumulative', 4)}, {_r('m4', 'rolling_mean_4w', 4)}, {_r('m12', 'rolling_mean_12w', 4)}, CAST(MONTH(date) AS INTEGER) AS month, CAST(QUARTER(date) AS INTEGER) AS quarter, {_r('x', 'time_idx')}, {_I} FROM segment_weekly",
    "p1_validate": f"SELECT {_K}, COUNT(*) AS rows FROM flag_weekly GROUP BY k",
    "p2_fold_subset": f"SELECT {_K}, fold, role, {_I}, {_r('x', 'x')}, {_r('y', 'y')} FROM flag_roles",
    "p3_last_fold": "SELECT k AS o_custkey, role, COUNT(*) AS rows, CAST(MIN(pos) AS INTEGER) AS first_pos, CAST(MAX(pos) AS INTEGER) AS last_pos FROM (SELECT k, pos, role FROM cust_roles WHERE fold = splits - 1 UNION ALL SELECT k, pos, 'train' FROM cust_target WHERE k IN (SELECT k FROM cust_plan WHERE status <> 'ok')) GROUP BY k, role",
    "p4_drop_missing": f"SELECT k AS l_suppkey, {_r('AVG(cumulative)', 'mean_predicted', 4)}, {_r('STDDEV_SAMP(cumulative)', 'std_dev_predicted', 4)}, {_r('MIN(cumulative)', 'min_predicted', 4)}, {_r('MAX(cumulative)', 'max_predicted', 4)} FROM supp_gaps GROUP BY k",
    "p5_complete_rows": f"SELECT {_K}, model, {_r('(1 - a + b + 1 - c) / 3', 'overall_score', 5)} FROM (SELECT *, (rmse - MIN(rmse) OVER s) / (MAX(rmse) OVER s - MIN(rmse) OVER s + 1e-10) AS a, (r2 - MIN(r2) OVER s) / (MAX(r2) OVER s - MIN(r2) OVER s + 1e-10) AS b, (mae - MIN(mae) OVER s) / (MAX(mae) OVER s - MIN(mae) OVER s + 1e-10) AS c FROM metrics WHERE model <> 'Gompertz' WINDOW s AS (PARTITION BY k))",
    "p6_filter_metric": f"SELECT {_K}, model, metric, {_r('score', 'score', 3)} FROM long_metrics WHERE metric = 'rmse'",
    "p7_present_columns": f"SELECT {_K}, model AS \"Model\", type AS \"Type\", {_r('rmse', _QUOTED['rmse'], 3)}, {_r('r2', _QUOTED['r2'], 6)} FROM metrics",
    "w2_fill_calendar": f"SELECT k AS l_suppkey, {_day()}, {_r('number', 'number', 6)}, {_r('cumulative', 'cumulative', 6)} FROM supp_gaps",
    "w3_rolling_means": f"SELECT k AS l_suppkey, {_day()}, {_r('m4', 'rolling_mean_4w', 4)}, {_r('m12', 'rolling_mean_12w', 4)} FROM supp_rolled",
    "w4_fill_missing": f"SELECT k AS l_suppkey, {_day()}, {_r('cumulative', 'cumulative', 4)}, {_r('m4', 'rolling_mean_4w', 4)}, {_r('m12', 'rolling_mean_12w', 4)} FROM supp_weekly",
    "w5_month_quarter": f"SELECT {_K}, {_day()}, CAST(MONTH(date) AS INTEGER) AS month, CAST(QUARTER(date) AS INTEGER) AS quarter FROM flag_weekly",
    "w6_time_index": f"SELECT {_K}, {_day()}, {_r('x', 'time_idx', 6)} FROM flag_weekly",
    "w7_row_position": f"SELECT k AS o_custkey, {_day()}, {_I}, CAST(pos AS DOUBLE) AS time_idx FROM cust_weekly",
    "w8_monthly_mean": f"SELECT {_K}, CAST(MONTH(date) AS INTEGER) AS month, {_r('AVG(number)', 'mean_number', 4)} FROM flag_weekly GROUP BY 1, 2",
    "w9_yearly_distribution": _BOX,
    "w10_counts_over_time": f"SELECT {_K}, {_day()}, {_r('number', 'number')}, {_r('cumulative', 'cumulative')} FROM flag_weekly",
    "c2_running_maximum": f"SELECT {_K}, {_I}, {_r('MAX(number) OVER (PARTITION BY k ORDER BY pos)', 'y')} FROM flag_weekly",
    "c3_split_count": "SELECT k AS o_custkey, n, splits AS k, block, status FROM cust_plan",
    "c4_folds": "SELECT k AS o_custkey, fold, n, splits AS k, train_end, test_start, test_end FROM cust_folds",
    "j1_fold_membership": f"SELECT k AS o_custkey, fold, role, COUNT(*) AS rows, CAST(MIN(pos) AS INTEGER) AS first_pos, {_r('MAX(y)', 'max_y')} FROM cust_roles GROUP BY ALL",
    "g1_exponential": f"SELECT {_K}, {_I}, {_r('ymax / 2 * exp(0.005 * x) + ymin', 'value')} FROM flag_target JOIN facts USING (k)",
    "g2_logistic": f"SELECT {_K}, {_I}, {_r('1.2 * ymax / (1 + exp(-0.01 * (x - xmid))) + ymin', 'value')} FROM flag_target JOIN facts USING (k)",
    "g3_richards": f"SELECT {_K}, {_I}, nu, {_r('1.2 * ymax / pow(1 + exp(-0.01 * (x - xmid)), 1 / nu) + ymin', 'value')} FROM flag_target JOIN facts USING (k) CROSS JOIN (VALUES (0.5::DOUBLE), (2.0::DOUBLE)) AS v(nu)",
    "g4_gompertz": f"SELECT {_K}, {_I}, {_r('ymin + (1.2 * ymax - ymin) * exp(-exp(-0.01 * (x - xmid)))', 'value')} FROM flag_target JOIN facts USING (k)",
    "f2_linear_pair": f"SELECT {_K}, model, CAST(fold AS INTEGER) AS fold, CAST(position AS INTEGER) AS position, {_r('value', 'value')} FROM (SELECT k, model, fold, unnest(range(len(params))) AS position, unnest(params) AS value FROM params)",
    "f4_skipped_folds": "SELECT k AS o_custkey, model, fold, train_end, CASE WHEN train_end >= size THEN 'ok' ELSE 'skipped' END AS status FROM cust_folds CROSS JOIN (VALUES ('Exponential', 3), ('Logistic', 4), ('Richards', 5), ('Gompertz', 4)) AS m(model, size)",
    "f6_best_fold": f"SELECT {_K}, model, fold AS best_fold, {_r('height', 'first_param')} FROM (SELECT p.*, ROW_NUMBER() OVER (PARTITION BY p.k, p.model ORDER BY m.r2 DESC, m.fold) AS rank FROM params p JOIN fold_metrics m ON m.k = p.k AND m.model = p.model AND m.fold = p.fold AND m.role = 'test') WHERE rank = 1",
    "f9_statuses": "SELECT model, status, COUNT(*) AS fits FROM (SELECT k AS o_custkey, model, fold, train_end, CASE WHEN train_end >= size THEN 'ok' ELSE 'skipped' END AS status FROM cust_folds CROSS JOIN (VALUES ('Exponential', 3), ('Logistic', 4), ('Richards', 5), ('Gompertz', 4)) AS m(model, size)) GROUP BY ALL",
    "f9_fit_statuses": f"SELECT {_K}, model, COUNT(*) AS fits, true AS sound FROM ranges CROSS JOIN models GROUP BY k, model",
    "a1_rmse": f"SELECT {_K}, model, fold, role, {_r('rmse', 'rmse', 3)}, n FROM fold_metrics",
    "a2_mae": f"SELECT {_K}, model, fold, role, {_r('mae', 'mae', 3)}, n FROM fold_metrics",
    "a3_r2": f"SELECT {_K}, model, fold, role, {_r('r2', 'r2', 5)}, n FROM fold_metrics",
    "a4_fold_summary": f"SELECT {_K}, model, folds, {', '.join(_r(c, c, 3) for c in ('test_rmse', 'test_rmse_std', 'test_mae', 'test_mae_std', 'train_rmse'))} FROM curve_metrics",
    "a5_full_in_sample": f"SELECT {_K}, model, {_r('rmse', 'rmse', 3)}, {_r('r2', 'r2', 6)}, {_r('mae', 'mae', 3)}, n, 'full_in_sample' AS scope FROM average_metrics",
    "a6_prediction_summary": f"SELECT {_K}, model, {_r('AVG(pred)', 'mean_predicted', 3)}, {_r('STDDEV_SAMP(pred)', 'std_dev_predicted', 3)}, {_r('MIN(pred)', 'min_predicted', 3)}, {_r('MAX(pred)', 'max_predicted', 3)} FROM curve_preds GROUP BY k, model",
    "x1_time_norm": f"SELECT {_K}, fold, role, {_I}, {_r('(x - low) / (high - low + 1e-9)', 'time_norm', 6)} FROM (SELECT *, MIN(x) FILTER (role = 'train') OVER (PARTITION BY k, fold) AS low, MAX(x) FILTER (role = 'train') OVER (PARTITION BY k, fold) AS high FROM flag_roles)",
    "x2_curve_columns": f"SELECT {_K}, {_I}, " + ", ".join(_r(f"MAX(CASE WHEN model = '{m}' THEN pred END)", f'"{m}"') for m in _CURVES) + " FROM curve_preds GROUP BY k, pos",
    "x3_time_waves": f"SELECT {_K}, {_I}, {_r('SIN(2 * PI() * t)', 'time_norm_sin', 6)}, {_r('COS(2 * PI() * t)', 'time_norm_cos', 6)} FROM (SELECT k, pos, (x - xlo) / (xhi - xlo + 1e-9) AS t FROM flag_target JOIN facts USING (k))",
    "e1_components": f"SELECT {_K}, model, CAST(fold AS INTEGER) AS fold, {_r('height', 'first_param')} FROM parts",
    "e2_simple_average": f"SELECT {_K}, {_I}, model, {_r('pred', 'pred')} FROM average_preds WHERE model = '{SIMPLE}'",
    "e5_weighted_average": f"SELECT {_K}, {_I}, model, {_r('pred', 'pred')} FROM average_preds WHERE model = '{BY_R2}'",
    "e5_weighted_average_mse": f"SELECT {_K}, {_I}, model, {_r('pred', 'pred')} FROM average_preds WHERE model = '{BY_MSE}'",
    "e3_r2_weights": f"SELECT {_K}, model, {_r('r2_weight', 'r2_weight', 6)} FROM weights",
    "e4_mse_weights": f"SELECT {_K}, model, {_r('inv_mse_weight', 'inv_mse_weight', 6)} FROM weights",
    "e6_component_report": f"SELECT {_K}, model, {_r('r2', 'r2', 5)}, {_r('mse', 'mse', 1)}, {_r('r2_weight', 'r2_weight', 5)}, {_r('inv_mse_weight', 'inv_mse_weight', 5)} FROM weights",
    "e7_combined": f"SELECT {_K}, {_I}, {_r('y', 'y')}, model, {_r('pred', 'pred')} FROM {_BOTH}",
    "b1_best_model": f"SELECT {_K}, best_model, {_r('best_score', 'best_score', 5)} FROM best",
    "b1_secondary_measure": f"SELECT {_K}, model AS best_model, {_r('r2', 'best_score', 5)} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY r2 DESC, place) AS rank FROM metrics) WHERE rank = 1",
    "b2_combined_metrics": f"SELECT {_K}, model, type, scope, {_r('rmse', 'rmse', 3)}, {_r('r2', 'r2', 5)}, {_r('mae', 'mae', 3)} FROM metrics",
    "b3_overall_score": f"SELECT {_K}, model, {_r('overall_score', 'overall_score', 5)} FROM overall",
    "b4_top_models": f"SELECT {_K}, CAST(rank AS INTEGER) AS rank, model, fold, {_r('rmse', 'rmse', 3)} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY rmse, model) AS rank FROM fold_metrics WHERE role = 'test') WHERE rank <= 3",
    "b5_melt": f"SELECT {_K}, model, metric, {_r('score', 'score', 3)} FROM long_metrics",
    "h1_horizon": f"SELECT {_K}, {_day()}, pos, {_r('x', 'x', 6)} FROM future",
    "h2_curve_forecast": f"SELECT {_K}, pos, model, {_r('pred', 'pred')} FROM future_curve",
    "h3_ensemble_forecast": f"SELECT {_K}, pos, model, {_r('pred', 'pred')} FROM future_ensemble",
    "r1_coefficients": f"SELECT {_K}, model AS \"Model\", unnest(names) AS \"Parameter\", {_r('unnest(params)', '\"Value\"')} FROM (SELECT *, CASE model WHEN 'Exponential' THEN ['a', 'b', 'c'] WHEN 'Richards' THEN ['L', 'k', 't0', 'nu', 'c_offset'] ELSE ['L', 'k', 't0', 'c_offset'] END AS names FROM params WHERE fold = -1)",
    "r2_standalone_metrics": f"SELECT {_K}, model AS \"Model\", {_r('test_rmse', _QUOTED['rmse'], 3)}, {_r('test_r2', _QUOTED['r2'], 5)}, {_r('test_mae', _QUOTED['mae'], 3)} FROM curve_metrics",
    "r3_ensemble_inputs": _wide([*_CURVES, SIMPLE], _BOTH).format(extra=""),
    "r4_full_predictions": _wide([*_CURVES, *_AVERAGES], _BOTH).format(extra=_r("MAX(y)", '"Actual"') + ", "),
    "r5_prediction_summary": f"SELECT {_K}, model || '_Pred' AS \"Model\", {_r('AVG(pred)', '\"Mean_Predicted\"', 3)}, {_r('STDDEV_SAMP(pred)', '\"Std_Dev_Predicted\"', 3)}, {_r('MIN(pred)', '\"Min_Predicted\"', 3)}, {_r('MAX(pred)', '\"Max_Predicted\"', 3)} FROM {_BOTH} GROUP BY k, model",
    "r6_weighted_comparison": f"SELECT {_K}, CASE model WHEN '{BY_R2}' THEN 'R²' ELSE 'Inverse MSE' END AS \"Weighting_Method\", {_r('rmse', _QUOTED['rmse'], 3)}, {_r('r2', _QUOTED['r2'], 6)}, {_r('mae', _QUOTED['mae'], 3)} FROM average_metrics WHERE model <> '{SIMPLE}'",
    "r7_weighted_parameters": f"SELECT p.k AS l_returnflag, p.model AS \"Model\", {_r('w.r2_weight', '\"Weight_R2\"', 6)}, {_r('w.inv_mse_weight', '\"Weight_InvMSE\"', 6)}, CASE WHEN p.model = 'Exponential' THEN 'b (rate)' ELSE 'k (rate)' END AS \"Growth_Rate_Param\", {_r('p.params[2]', '\"Growth_Rate_Value\"', 6)} FROM params p LEFT JOIN weights w ON w.k = p.k AND w.model = p.model WHERE p.fold = -1",
    "r8_overall_metrics": f"SELECT {_K}, model AS \"Model\", type AS \"Type\", {_r('rmse', _QUOTED['rmse'], 3)}, {_r('r2', _QUOTED['r2'], 5)}, {_r('mae', _QUOTED['mae'], 3)} FROM metrics",
    "d1_residuals": f"SELECT {_K}, model, {_I}, {_r('pred', 'pred')}, {_r('residual', 'residual')} FROM resid",
    "d4_observed_fitted": f"SELECT s.k AS l_returnflag, {_day('date')}, CAST(s.pos AS INTEGER) AS pos, {_r('s.x', 'x')}, {_r('s.y', 'y')}, split, model, {_r('pred', 'pred')} FROM flag_split s JOIN curve_preds c ON c.k = s.k AND c.pos = s.pos",
    "d4_single_fit": f"SELECT s.k AS l_returnflag, {_day('date')}, CAST(s.pos AS INTEGER) AS pos, {_r('s.y', 'y')}, split, model, {_r('pred', 'pred')}, {_r('rmse', 'rmse')}, {_r('r2', 'r2')}, {_r('mae', 'mae')} FROM flag_split s JOIN curve_preds c ON c.k = s.k AND c.pos = s.pos AND c.model = 'Gompertz' JOIN (SELECT k AS mk, {_SCORE} FROM curve_preds WHERE model = 'Gompertz' GROUP BY k) m ON m.mk = s.k",
    "d5_ensemble_comparison": f"SELECT s.k AS l_returnflag, CAST(s.pos AS INTEGER) AS pos, split, c.model, CAST(plot_order AS INTEGER) AS plot_order, {_r('c.pred', 'pred')} FROM flag_split s JOIN (SELECT k, pos, model, place - 9 AS plot_order, pred FROM average_preds UNION ALL SELECT c.k, c.pos, c.model, 0, c.pred FROM curve_preds c JOIN best b ON b.k = c.k AND b.type = 'Individual' AND b.best_model = c.model) c ON c.k = s.k AND c.pos = s.pos",
    "d6_validation": f"SELECT c.k AS l_returnflag, CAST(c.pos AS INTEGER) AS pos, {_r('c.y', 'y')}, c.model AS curve_model, {_r('c.pred', 'curve_pred')}, e.model AS ensemble_model, {_r('e.pred', 'ensemble_pred')}, {', '.join(_r(f'{a}.{m}', f'{n}_{m}') for a, n in (('cs', 'curve'), ('es', 'ensemble')) for m in ('rmse', 'mae', 'r2'))} FROM curve_preds c JOIN best b ON b.k = c.k AND b.type = 'Individual' AND b.best_model = c.model JOIN best d ON d.k = c.k AND d.type = 'Ensemble' JOIN average_preds e ON e.k = c.k AND e.pos = c.pos AND e.model = d.best_model JOIN (SELECT k, model, {_SCORE} FROM curve_preds GROUP BY k, model) cs ON cs.k = c.k AND cs.model = c.model JOIN average_metrics es ON es.k = c.k AND es.model = e.model",
    "d7_ensemble_diagnostics": f"SELECT a.k AS l_returnflag, a.model, CAST(a.pos AS INTEGER) AS pos, {_r('pred', 'pred')}, {_r('a.y - pred', 'residual')} FROM average_preds a JOIN flag_split s ON s.k = a.k AND s.pos = a.pos AND s.split = 'test'",
    "d8_metric_panels": f"SELECT {_K}, model, type, metric, {_r('score', 'score', 3)} FROM (SELECT k, model, type, unnest(['rmse', 'r2', 'mae', 'overall_score']) AS metric, unnest([rmse, r2, mae, overall_score]) AS score FROM overall)",
    "d10_weighted_panels": f"SELECT {_K}, CASE model WHEN '{BY_R2}' THEN 'R²' ELSE 'Inverse MSE' END AS \"Weighting_Method\", metric AS \"Metric\", {_r('score', '\"Score\"', 3)} FROM (SELECT k, model, unnest(['RMSE', 'R²', 'MAE']) AS metric, unnest([rmse, r2, mae]) AS score FROM average_metrics WHERE model <> '{SIMPLE}')",
    "d11_exploratory": f"SELECT {_K}, panel, label, measure, {_r('value', 'value', 4)} FROM (SELECT k, 'over_time' AS panel, strftime(date, '%Y-%m-%d') AS label, unnest(['number', 'cumulative']) AS measure, unnest([number, cumulative]) AS value FROM flag_weekly UNION ALL SELECT k, 'by_month', CAST(MONTH(date) AS VARCHAR), 'mean_number', AVG(number) FROM flag_weekly GROUP BY k, MONTH(date) UNION ALL SELECT l_returnflag, 'by_year', CAST(year AS VARCHAR), unnest(['q1', 'median', 'q3', 'low_whisker', 'high_whisker', 'outliers']), unnest([q1, median, q3, low_whisker, high_whisker, outliers]) FROM ({_BOX}))",
}

ORACLE: dict[str, str] = {name: _WITH + text for name, text in _TABLES.items()}

# start values with their finite bounds
ORACLE["f1_start_values"] = _WITH + f"""SELECT {_K}, model, CAST(position AS INTEGER) AS position, {_r('start', 'start', 4)}, {_r('lower', 'lower', 4)}, {_r('upper', 'upper', 4)} FROM (
  SELECT k, 'Exponential' AS model, unnest([0, 1, 2]) AS position, unnest([ymax / 2, 0.005, ymin]) AS start, unnest([0, 0.0001, NULL]) AS lower, unnest([2 * ymax, 0.1, NULL]) AS upper FROM facts
  UNION ALL SELECT k, m, unnest([0, 1, 2, 3]), unnest([1.2 * ymax, 0.01, xmid, ymin]), unnest([ymax, 0.001, xlo, NULL]), unnest([2 * ymax, 0.1, xhi, NULL]) FROM facts CROSS JOIN (VALUES ('Logistic'), ('Gompertz')) AS t(m)
  UNION ALL SELECT k, 'Richards', unnest([0, 1, 2, 3, 4]), unnest([1.2 * ymax, 0.01, xmid, 1, ymin]), unnest([ymax, 0.001, xlo, 0.1, NULL]), unnest([2 * ymax, 0.1, xhi, 10, NULL]) FROM facts)"""


def _rate_search(shape: str, columns: str = "") -> str:
    """Root mean squared error of the best of many rates for a shape of b and x without a midpoint."""
    u = f"({shape})"
    return _WITH.rstrip() + f""",
coarse_rates AS (SELECT exp(ln(0.0001) + i * (ln(0.1) - ln(0.0001)) / 1500) AS b FROM (SELECT unnest(range(0, 1501)) AS i)),
coarse AS (SELECT k, b, ymax, COUNT(*) AS n, SUM({u}) AS su, SUM({u} * {u}) AS suu, SUM(y) AS sy, SUM({u} * y) AS suy, REGR_SYY(y, y) AS cyy FROM flag_target JOIN facts f USING (k) CROSS JOIN coarse_rates GROUP BY k, b, ymax),
coarse_fit AS (SELECT *, suu - su * su / n AS cuu, suy - su * sy / n AS cuy, LEAST(GREATEST((suy - su * sy / n) / (suu - su * su / n), 0), 2 * ymax) AS a FROM coarse),
coarse_best AS (SELECT k, ARG_MIN(b, cyy - 2 * a * cuy + a * a * cuu) AS b FROM coarse_fit GROUP BY k),
fine_rates AS (SELECT k, GREATEST(LEAST(b * exp((i - 1500) * 0.0046 / 1500), 0.1), 0.0001) AS b FROM coarse_best CROSS JOIN (SELECT unnest(range(0, 3001)) AS i)),
fine AS (SELECT t.k, r.b, f.ymax, COUNT(*) AS n, SUM({u.replace('b *', 'r.b *')}) AS su, SUM({u.replace('b *', 'r.b *')} * {u.replace('b *', 'r.b *')}) AS suu, SUM(y) AS sy, SUM({u.replace('b *', 'r.b *')} * y) AS suy, REGR_SYY(y, y) AS cyy FROM flag_target t JOIN facts f ON f.k = t.k JOIN (SELECT DISTINCT * FROM fine_rates) r ON r.k = t.k GROUP BY t.k, r.b, f.ymax),
fine_fit AS (SELECT *, suu - su * su / n AS cuu, suy - su * sy / n AS cuy, LEAST(GREATEST((suy - su * sy / n) / (suu - su * su / n), 0), 2 * ymax) AS a FROM fine)
SELECT {_K}, {columns}{_r('SQRT(MIN(cyy - 2 * a * cuy + a * a * cuu) / MAX(n))', 'rmse', 2)} FROM fine_fit GROUP BY k"""


ORACLE["f7_exponential_optimum"] = _rate_search("exp(b * x)")
ORACLE["f2_registered_curve"] = _rate_search("1 - exp(-b * x)", "'Monomolecular' AS model, ")

_FEATURES = """
first_preds AS (SELECT s.k, s.pos, s.model, p.alpha + p.beta * s.u AS pred FROM shaped s JOIN params p ON p.k = s.k AND p.model = s.model AND p.fold = 0),
curve_columns AS (SELECT k, pos, """ + ", ".join(f"MAX(CASE WHEN model = '{m}' THEN pred END) AS \"{m}\"" for m in _CURVES) + """ FROM first_preds GROUP BY k, pos),
feature_rows AS (
  SELECT c.*, (t.x - xlo) / (xhi - xlo + 1e-9) AS time_norm, SIN(2 * PI() * (t.x - xlo) / (xhi - xlo + 1e-9)) AS time_norm_sin, COS(2 * PI() * (t.x - xlo) / (xhi - xlo + 1e-9)) AS time_norm_cos
  FROM curve_columns c JOIN flag_target t ON t.k = c.k AND t.pos = c.pos JOIN facts f ON f.k = c.k)"""  # fmt: skip
_NAMES = [*_CURVES, "time_norm", "time_norm_sin", "time_norm_cos"]
ORACLE["x4_features"] = _WITH.rstrip() + "," + _FEATURES + f"\nSELECT {_K}, {_I}, " + ", ".join(_r(f'"{n}"', f'"{n}"') for n in _NAMES) + " FROM feature_rows"
ORACLE["x5_scaled_features"] = _WITH.rstrip() + "," + _FEATURES + f"\nSELECT {_K}, {_I}, " + ", ".join(_r(f'("{n}" - AVG("{n}") OVER (PARTITION BY k)) / STDDEV_POP("{n}") OVER (PARTITION BY k)', f'"{n}"', 5) for n in _NAMES) + " FROM feature_rows"

ORACLE["d2_normal_qq"] = _WITH.rstrip() + f""",
placed AS (SELECT k, model, residual, ROW_NUMBER() OVER (PARTITION BY k, model ORDER BY residual, pos) AS rank, COUNT(*) OVER (PARTITION BY k, model) AS n FROM resid),
located AS (SELECT *, CASE WHEN rank = n THEN POW(0.5, 1.0 / n) WHEN rank = 1 THEN 1 - POW(0.5, 1.0 / n) ELSE (rank - 0.3175) / (n + 0.365) END AS p FROM placed),
pairs AS (SELECT k, model, rank, residual, {_quantile_sql()} AS t FROM located),
lined AS (SELECT k AS lk, model AS lm, REGR_SLOPE(residual, t) AS slope, REGR_INTERCEPT(residual, t) AS intercept, REGR_R2(residual, t) AS line_r2 FROM pairs GROUP BY k, model)
SELECT {_K}, model, CAST(rank AS INTEGER) AS rank, {_r('t', 'theoretical', 6)}, {_r('residual', 'ordered')}, {_r('slope', 'slope')}, {_r('intercept', 'intercept')}, {_r('line_r2', 'line_r2', 5)}, {_r('intercept + slope * t', 'fitted')}
FROM pairs JOIN lined ON lk = k AND lm = model"""

ORACLE["d3_histogram"] = _WITH.rstrip() + "," + _BINS + f""",
counted AS (SELECT r.k, r.model, CAST(LEAST(GREATEST(FLOOR((residual - low) / width), 0), bins - 1) AS INTEGER) AS bin, COUNT(*) AS c FROM resid r JOIN bins b ON b.k = r.k AND b.model = r.model GROUP BY 1, 2, 3),
every_bin AS (SELECT *, CAST(unnest(range(bins)) AS INTEGER) AS bin FROM bins)
SELECT e.k AS l_returnflag, e.model, e.bin, {_r('low + width * e.bin', 'left_edge')}, {_r('low + width * e.bin + width', 'right_edge')}, COALESCE(c, 0) AS count
FROM every_bin e LEFT JOIN counted c ON c.k = e.k AND c.model = e.model AND c.bin = e.bin"""

ORACLE["d3_density"] = _WITH.rstrip() + "," + _BINS + f""",
grid AS (SELECT *, std * POW(n, -0.2) AS h, low + (high - low) * point / 199.0 AS residual_at FROM (SELECT *, CAST(unnest(range(200)) AS INTEGER) AS point FROM bins))
SELECT g.k AS l_returnflag, g.model, point, {_r('residual_at', 'residual_at', 3)}, {_r('AVG(EXP(-0.5 * ((residual_at - residual) / h) * ((residual_at - residual) / h)) / (h * SQRT(2 * PI()))) * ANY_VALUE(n) * ANY_VALUE(width)', 'scaled', 3)}
FROM grid g JOIN resid r ON r.k = g.k AND r.model = g.model GROUP BY g.k, g.model, point, residual_at"""

ORACLE["s4_clustered_reports"] = "SELECT l_suppkey, CAST((MAX(week) - MIN(week)) / 7 + 1 AS BIGINT) AS weeks, CAST(1 AS BIGINT) AS files FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) + CAST(7 - isodow(CAST(l_shipdate AS DATE)) AS INTEGER) AS week FROM lineitem) GROUP BY l_suppkey"
ORACLE["s1_load"] = f"SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS ts, {_r('o_totalprice', 'number')}, CAST(o_orderkey AS DOUBLE) AS cumulative FROM orders"
ORACLE["s2_select_columns"] = f"SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS ts, {_r('o_totalprice', 'number')}, CAST(o_orderkey AS DOUBLE) AS cumulative FROM orders"
ORACLE["s3_parse_dates"] = "SELECT o_orderstatus, COUNT(*) AS rows, COUNT(*) FILTER (TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN 'P' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) IS NULL) AS rejected FROM orders GROUP BY 1"
ORACLE["w1_weekly_resample"] = f"SELECT event_type, strftime(d + CAST(7 - isodow(d) AS INTEGER), '%Y-%m-%d') AS date, {_r('SUM(value)', 'number')}, CAST(ARG_MAX(event_id, ts) AS DOUBLE) AS cumulative FROM (SELECT *, CAST(ts AS DATE) AS d FROM events) GROUP BY 1, 2"
ORACLE["w1_weekly_by_time"] = ORACLE["w1_weekly_resample"]
ORACLE["w1_weekly_last_of_day"] = f"SELECT k AS o_orderpriority, strftime(week, '%Y-%m-%d') AS date, {_r('SUM(v)', 'number')}, CAST(MAX(o_orderkey) FILTER (d = last_day) AS DOUBLE) AS cumulative FROM (SELECT *, MAX(d) OVER (PARTITION BY k, week) AS last_day FROM (SELECT o_orderpriority AS k, o_orderkey, o_totalprice AS v, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(7 - isodow(CAST(o_orderdate AS DATE)) AS INTEGER) AS week FROM orders)) GROUP BY k, week"
ORACLE["c1_target_repair"] = f"""WITH r AS (SELECT event_type AS k, CAST(ts AS DATE) + CAST(7 - isodow(CAST(ts AS DATE)) AS INTEGER) AS date, ts, event_id, CASE WHEN event_type <> 'error' AND value > 20 THEN event_id END AS c FROM events),
w AS (SELECT k, date, ARG_MAX(c, ts) FILTER (c IS NOT NULL) AS c FROM r GROUP BY k, date),
f AS (SELECT k, date, COALESCE(LAST_VALUE(c IGNORE NULLS) OVER b, FIRST_VALUE(c IGNORE NULLS) OVER a) AS c FROM w
  WINDOW b AS (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT k AS event_type, strftime(date, '%Y-%m-%d') AS date, CASE WHEN k = 'error' THEN 'invalid_target' ELSE 'ok' END AS status, CAST(MAX(c) OVER (PARTITION BY k ORDER BY date) AS DOUBLE) AS y FROM f"""


def _noise(part: str) -> str:
    digits = f"md5(concat_ws('|', '42', '{part}', i, k, model, draw))[1:13]"
    return f"((CAST('0x' || {digits} AS BIGINT) + 0.5) / 4503599627370496.0)"


# The best curve of each series with 1,000 draws of its parameters, and the curve of every draw in every future week.
_DRAWS = f""",
drawn AS (
  SELECT p.k, p.model, d AS draw, i, p.params[i + 1] AS value FROM params p JOIN best b ON b.k = p.k AND b.best_model = p.model AND b.type = 'Individual'
  CROSS JOIN range(1000) AS r(d) CROSS JOIN range(5) AS s(i) WHERE p.fold = -1 AND i < len(p.params)),
noisy AS (
  SELECT k, model, draw, i, value * (1 + 0.05 * sqrt(-2 * ln({_noise("radius")})) * cos(2 * pi() * {_noise("angle")})) AS value FROM drawn),
noisy_lists AS (SELECT k, model, draw, list(value ORDER BY i) AS p FROM noisy GROUP BY ALL),
draw_preds AS (
  SELECT f.k, f.pos, CASE n.model WHEN 'Exponential' THEN p[1] * exp(p[2] * f.x) + p[3] WHEN 'Logistic' THEN p[1] / (1 + exp(-p[2] * (f.x - p[3]))) + p[4]
    WHEN 'Richards' THEN p[1] / pow(1 + exp(-p[2] * (f.x - p[3])), 1 / p[4]) + p[5] ELSE p[4] + (p[1] - p[4]) * exp(-exp(-p[2] * (f.x - p[3]))) END AS pred
  FROM future f JOIN noisy_lists n ON n.k = f.k),
bounds AS (SELECT k, pos, AVG(pred) AS mean_pred, QUANTILE_CONT(pred, 0.025) AS low, QUANTILE_CONT(pred, 0.975) AS high FROM draw_preds GROUP BY ALL)"""
_AHEAD = _WITH.rstrip() + _DRAWS
ORACLE["h4_noisy_parameters"] = _AHEAD + f"\nSELECT {_K}, model, CAST(i AS INTEGER) AS position, {_r('AVG(value)', 'mean', 4)}, {_r('STDDEV_POP(value)', 'std', 4)} FROM noisy GROUP BY k, model, i"
ORACLE["h5_interval"] = _AHEAD + f"\nSELECT {_K}, {_I}, {_r('mean_pred', 'mean_pred')}, {_r('low', 'lower_bound_ci')}, {_r('high', 'upper_bound_ci')} FROM bounds"
ORACLE["h6_forecast_table"] = _AHEAD + f"\nSELECT c.k AS l_returnflag, {_day('date')}, {_r('c.x', 'time_idx')}, {_r('c.pred', 'best_model_forecast')}, {_r('e.pred', 'best_ensemble_forecast')}, {_r('b.low', 'lower_bound_ci')}, {_r('b.high', 'upper_bound_ci')} FROM future_curve c JOIN future_ensemble e ON e.k = c.k AND e.pos = c.pos JOIN bounds b ON b.k = c.k AND b.pos = c.pos"


def _search(levels: int = 6) -> str:
    """Least error of the curves without asymmetry over whole series: a grid over rate and midpoint, then finer around its best.

    A grid over three numbers gets stuck beside the Richards curve's optimum; it is held against the logistic curve, its special case.
    """
    parts = [
        """area0 AS (SELECT k, model, ymax, n, CASE WHEN model = 'Exponential' THEN ln(0.0001) ELSE ln(0.001) END AS r0, ln(0.1) AS r1,
  CASE WHEN model = 'Exponential' THEN 0 ELSE xlo END AS t0, CASE WHEN model = 'Exponential' THEN 0 ELSE xhi END AS t1, xlo, xhi FROM facts CROSS JOIN models WHERE model <> 'Richards')"""
    ]
    for level in range(levels):
        parts.append(f"""sized{level} AS (SELECT *, CASE WHEN model = 'Exponential' THEN 200 ELSE 24 END AS nr, CASE WHEN model = 'Exponential' THEN 1 ELSE 24 END AS nt FROM area{level}),
grid{level} AS (SELECT *, exp(r0 + i * (r1 - r0) / (nr - 1)) AS b, t0 + j * (t1 - t0) / greatest(nt - 1, 1) AS t
  FROM sized{level} CROSS JOIN range(200) AS i(i) CROSS JOIN range(24) AS j(j) WHERE i < nr AND j < nt),
u{level} AS (SELECT g.k, g.model, g.b, g.t, g.ymax, y, CASE g.model WHEN 'Exponential' THEN exp(b * x) WHEN 'Gompertz' THEN exp(-exp(-b * (x - t))) ELSE 1 / (1 + exp(-b * (x - t))) END AS u
  FROM grid{level} g JOIN flag_target f ON f.k = g.k),
s{level} AS (SELECT k, model, b, t, ymax, COUNT(*) AS n, SUM(u) AS su, SUM(y) AS sy, SUM(u * y) AS suy, SUM(u * u) AS suu, REGR_SYY(y, u) AS cyy, REGR_SXX(y, u) AS cuu, REGR_SXY(y, u) AS cuy FROM u{level} GROUP BY ALL),
w{level} AS (SELECT *, cuy / cuu AS slope, CASE WHEN model = 'Gompertz' THEN (sy - cuy / cuu * su) / n + cuy / cuu ELSE cuy / cuu END AS wanted FROM s{level} WHERE cuu > 0),
h{level} AS (SELECT *, least(greatest(wanted, CASE WHEN model = 'Exponential' THEN 0 ELSE ymax END), 2 * ymax) AS height FROM w{level}),
o{level} AS (SELECT *, CASE WHEN model <> 'Gompertz' THEN (sy - height * su) / n WHEN height = wanted THEN height - slope ELSE ((sy - suy) - height * (su - suu)) / (n - 2 * su + suu) END AS alpha FROM h{level}),
e{level} AS (SELECT *, CASE WHEN model = 'Gompertz' THEN height - alpha ELSE height END AS beta FROM o{level}),
q{level} AS (SELECT *, cyy - 2 * beta * cuy + beta * beta * cuu + n * pow(alpha - (sy - beta * su) / n, 2) AS sse FROM e{level}),
best{level} AS (SELECT k, model, ARG_MIN(b, sse) AS b, ARG_MIN(t, sse) AS t, MIN(sse) AS sse FROM q{level} GROUP BY ALL),
area{level + 1} AS (SELECT k, model, ymax, n, greatest(ln(b) - 2.5 * (r1 - r0) / (nr - 1), CASE WHEN model = 'Exponential' THEN ln(0.0001) ELSE ln(0.001) END) AS r0, least(ln(b) + 2.5 * (r1 - r0) / (nr - 1), ln(0.1)) AS r1,
  greatest(t - 2.5 * (t1 - t0) / greatest(nt - 1, 1), CASE WHEN model = 'Exponential' THEN 0 ELSE xlo END) AS t0, least(t + 2.5 * (t1 - t0) / greatest(nt - 1, 1), CASE WHEN model = 'Exponential' THEN 0 ELSE xhi END) AS t1, xlo, xhi
  FROM sized{level} JOIN best{level} USING (k, model))""")
    least = " UNION ALL ".join(f"SELECT k, model, sse FROM best{level}" for level in range(levels))
    parts.append(f"least AS (SELECT k, model, SQRT(MIN(sse) / MAX(n)) AS rmse FROM ({least}) JOIN facts USING (k) GROUP BY ALL UNION ALL SELECT k, 'Richards', NULL FROM facts)")
    return ",\n".join(parts)


def _digits(value: str) -> str:
    size = f"pow(10, floor(log10({value})))"
    return f"ROUND({value} / {size}, 3) * {size}"


_LEAST = _WITH.rstrip() + ",\n" + _search()
ORACLE["f2_full_fit"] = _LEAST + f"\nSELECT {_K}, model, {_r(_digits('rmse'), 'rmse', 4)}, true AS no_worse FROM least"
ORACLE["f7_final_fit"] = ORACLE["f2_full_fit"]


def _grid(points: int = 9, rounds: int = 3) -> str:
    """The least error of every curve on a grid over its bounds, zoomed in to one step around the best again and again."""
    last = points - 1
    steps = [
        f"""curve_bounds(model, klo, khi, mid, asym, least, absolute) AS (VALUES ('Exponential', 0.0001, 0.1, false, false, 0.0, false),
  ('Logistic', 0.001, 0.1, true, false, 1.0, false), ('Richards', 0.001, 0.1, true, true, 1.0, false), ('Gompertz', 0.001, 0.1, true, false, 1.0, true)),
g0 AS (SELECT k, model, mid, asym, absolute, ymax * least AS hlo, 2 * ymax AS hhi, ln(klo) AS kmin, ln(khi) AS kmax, xlo AS tmin, xhi AS tmax, ln(0.1) AS dmin, ln(10.0) AS dmax,
  ln(klo) AS k0, ln(khi) AS k1, xlo AS t0, xhi AS t1, ln(0.1) AS d0, ln(10.0) AS d1 FROM facts CROSS JOIN curve_bounds)"""
    ]
    for r in range(rounds):
        steps.append(f"""c{r} AS (SELECT g.*, a * {points * points} + b * {points} + c AS place, k0 + a * (k1 - k0) / {last} AS gk, CASE WHEN mid THEN t0 + b * (t1 - t0) / {last} ELSE 0 END AS gt, CASE WHEN asym THEN d0 + c * (d1 - d0) / {last} ELSE 0 END AS gd
  FROM g{r} g CROSS JOIN range({points}) i(a) CROSS JOIN range({points}) j(b) CROSS JOIN range({points}) l(c) WHERE (mid OR b = 0) AND (asym OR c = 0)),
v{r} AS (SELECT c.k, c.model, c.place, y, CASE model WHEN 'Exponential' THEN exp(exp(gk) * x) WHEN 'Gompertz' THEN exp(-exp(-exp(gk) * (x - gt))) ELSE exp(-ln(1 + exp(least(-exp(gk) * (x - gt), 340))) / exp(gd)) END AS u
  FROM c{r} c JOIN flag_target t ON t.k = c.k),
s{r} AS (SELECT k, model, place, COUNT(*) AS n, SUM(u) AS su, SUM(y) AS sy, SUM(u * y) AS suy, SUM(u * u) AS suu, REGR_SYY(y, u) AS cyy, REGR_SXX(y, u) AS cuu, REGR_SXY(y, u) AS cuy FROM v{r} GROUP BY ALL),
w{r} AS (SELECT s.*, absolute, hlo, hhi, CASE WHEN cuu > 0 THEN cuy / cuu ELSE 0 END AS slope FROM s{r} s JOIN g{r} g ON g.k = s.k AND g.model = s.model),
h{r} AS (SELECT *, CASE WHEN absolute THEN (sy - slope * su) / n + slope ELSE slope END AS wanted FROM w{r}),
o{r} AS (SELECT *, least(greatest(wanted, hlo), hhi) AS height FROM h{r}),
p{r} AS (SELECT *, CASE WHEN NOT absolute THEN (sy - height * su) / n WHEN height = wanted THEN height - slope ELSE ((sy - suy) - height * (su - suu)) / (n - 2 * su + suu) END AS alpha FROM o{r}),
e{r} AS (SELECT *, CASE WHEN absolute THEN height - alpha ELSE height END AS beta FROM p{r}),
q{r} AS (SELECT k, model, n, place, cyy - 2 * beta * cuy + beta * beta * cuu + n * pow(alpha - (sy - beta * su) / n, 2) AS sse FROM e{r}),
b{r} AS (SELECT k, model, MAX(n) AS n, ARG_MIN(place, (sse, place)) AS place, MIN(sse) AS sse FROM q{r} GROUP BY k, model),
g{r + 1} AS (SELECT c.* EXCLUDE (place, gk, gt, gd) REPLACE (greatest(kmin, gk - (k1 - k0) / {last}) AS k0, least(kmax, gk + (k1 - k0) / {last}) AS k1, greatest(tmin, gt - (t1 - t0) / {last}) AS t0,
  least(tmax, gt + (t1 - t0) / {last}) AS t1, greatest(dmin, gd - (d1 - d0) / {last}) AS d0, least(dmax, gd + (d1 - d0) / {last}) AS d1) FROM c{r} c JOIN b{r} b ON b.k = c.k AND b.model = c.model AND b.place = c.place)""")
    found = " UNION ALL ".join(f"SELECT k, model, n, sse FROM b{r}" for r in range(rounds))
    return _WITH.rstrip() + ",\n" + ",\n".join(steps) + f",\nleast_on_grid AS (SELECT k, model, SQRT(MIN(sse) / MAX(n)) AS rmse FROM ({found}) GROUP BY k, model)"


ORACLE["f2_grid_seed"] = _grid() + f"\nSELECT {_K}, model, {_r(_digits('rmse'), 'rmse', 4)}, true AS no_worse FROM least_on_grid"
ORACLE["f8_no_folds"] = _LEAST + f"\nSELECT {_K}, model, {_r(_digits('rmse'), 'rmse', 4)}, true AS no_worse, 0 AS folds, NULL::DOUBLE AS test_rmse FROM least"
ORACLE["f3_fold_fits"] = _WITH + f"SELECT {_K}, model, COUNT(*) AS fits, COUNT(*) AS inside, COUNT(*) AS no_worse FROM flag_folds CROSS JOIN models GROUP BY k, model"
ORACLE["f5_fallback"] = _WITH + f"SELECT {_K}, 'Richards' AS model, COUNT(*) * 5 AS values, {_r('AVG((1.2 * ymax + 0.01 + xmid + 1 + ymin) / 5)', 'mean', 4)} FROM flag_folds JOIN facts USING (k) GROUP BY k"
ORACLE["s5_save_models"] = _WITH + f"SELECT p.k AS l_returnflag, p.model, 'ok' AS status, best_model FROM params p JOIN best b ON b.k = p.k AND b.type = 'Individual' WHERE p.fold = -1"
_WEEKS = "SELECT k AS l_returnflag, COUNT(*) AS weeks"
ORACLE["s6_load_models"] = _WITH + f"{_WEEKS}, 0.0::DOUBLE AS difference FROM flag_target GROUP BY k"
ORACLE["s7_predict"] = ORACLE["s6_load_models"]
for _name, _model in (("m1_forest_cv", "Random Forest"), ("m2_boosting_cv", "Gradient Boosting")):
    ORACLE[_name] = _WITH + f"SELECT {_K}, '{_model}' AS model, true AS ordered, true AS below_one FROM flag_folds GROUP BY k"
ORACLE["m3_forest_grid"] = _WITH + f"{_WEEKS}, COUNT(*) AS inside FROM flag_target GROUP BY k"
ORACLE["m4_boosting_grid"] = _WITH + f"{_WEEKS}, true AS offered, true AS explains FROM flag_target GROUP BY k"
ORACLE["m5_predict"] = _WITH + f"{_WEEKS}, COUNT(*) AS rows FROM flag_target GROUP BY k"
ORACLE["m6_importances"] = "SELECT model, 7 AS features, 1.0::DOUBLE AS total, true AS none_negative FROM (VALUES ('Random Forest'), ('Gradient Boosting')) AS m(model)"
ORACLE["d9_top_importances"] = "SELECT 'Random Forest' AS model, 5 AS ranks, true AS greatest"
_PER_SERIES = "SELECT k AS l_returnflag, COUNT(*) AS weeks"
ORACLE["s3_corrupt_lines"] = """
WITH found AS (SELECT o_orderstatus AS order_status, o_orderpriority IN ('1-URGENT', '2-HIGH') AS corrupt, o_orderpriority = '5-LOW' AS undated, o_orderstatus = 'P' AS priceless FROM orders)
SELECT order_status, 'corrupt_line' AS reason, COUNT(*) AS rows FROM found WHERE corrupt GROUP BY 1
UNION ALL SELECT order_status, 'unreadable_date', COUNT(*) FROM found WHERE NOT corrupt AND undated GROUP BY 1
UNION ALL SELECT order_status, 'unreadable_number', COUNT(*) FROM found WHERE NOT corrupt AND priceless GROUP BY 1
UNION ALL SELECT order_status, 'kept', COUNT(*) FROM found WHERE NOT (corrupt OR undated OR priceless) GROUP BY 1"""
ORACLE["x_fitted_features"] = _WITH + f"{_PER_SERIES}, COUNT(*) AS complete, true AS standard FROM flag_target GROUP BY k"
ORACLE["a_fitted_measures"] = _WITH + f"SELECT {_K}, model, CAST(SUM(train_end) AS BIGINT) AS train_rows, CAST(SUM(test_end - test_start) AS BIGINT) AS test_rows, true AS agree FROM flag_folds CROSS JOIN models GROUP BY k, model"
ORACLE["e_fitted_weights"] = _WITH + f"SELECT {_K}, COUNT(*) AS components, 1.0::DOUBLE AS r2_weight, 1.0::DOUBLE AS inv_mse_weight, true AS ordered FROM facts CROSS JOIN models GROUP BY k"
ORACLE["e_fitted_averages"] = _WITH + f"{_PER_SERIES}, COUNT(*) AS inside, a.model FROM flag_target CROSS JOIN (VALUES ('{SIMPLE}'), ('{BY_R2}'), ('{BY_MSE}')) a(model) GROUP BY k, a.model"
ORACLE["b_fitted_best"] = _WITH + f"SELECT {_K}, type, CAST(models AS BIGINT) AS models, true AS greatest FROM facts CROSS JOIN (VALUES ('Individual', 4), ('Ensemble', 3)) t(type, models)"
ORACLE["h_fitted_forecast"] = _WITH + f"SELECT {_K}, COUNT(*) AS weeks, COUNT(*) AS whole, COUNT(*) AS ordered FROM facts CROSS JOIN generate_series(1, 260) GROUP BY k"
# rows of each report: 16 parameters of four curves, one row per curve, week, model or weighted average
ORACLE["r_fitted_reports"] = _WITH + f"""SELECT {_K}, report, CAST(COALESCE(size, n) AS BIGINT) AS rows, CAST(COALESCE(size, n) AS BIGINT) AS values FROM facts
CROSS JOIN (VALUES ('coefficients', 16), ('standalone', 4), ('full', NULL), ('summary', 7), ('comparison', 2), ('parameters', 4), ('overall', 7)) r(report, size)"""
ORACLE["d_fitted_charts"] = _WITH + f"SELECT {_K}, model, COUNT(*) AS residuals, COUNT(*) AS binned, COUNT(*) AS placed, CAST(200 AS BIGINT) AS points, true AS mass FROM flag_target CROSS JOIN models GROUP BY k, model"
