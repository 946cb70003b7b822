"""DuckDB twins of the queries, assembled from shared common table expressions."""

CTE: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTE[name] = body


def sql(final: str) -> str:
    """``final`` preceded by the (transitively) needed expressions, in order."""
    import re

    def used(text: str) -> set[str]:
        return {w for w in re.findall(r"[a-z_0-9]+", text) if w in CTE}

    needed: set[str] = set()
    todo = used(final)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo |= used(CTE[name]) - needed
    parts = [f"{n} AS MATERIALIZED ({CTE[n]})" for n in CTE if n in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + final


def r(expr: str, alias: str | None = None, dp: int = 6) -> str:
    return f"(round({expr}, {dp}) + 0.0) AS {alias or expr}"


BARS = ("date, isin, symbol, series, open, high, low, close, prev_close, last, volume, "
        "turnover, n_trades")
FEATURES = ("ret_1", "ret_o", "ret_h", "ret_l", "ret_1_volscaled", "vol_z",
            "dow_sin", "dow_cos", "dom_sin", "dom_cos", "month_sin", "month_cos")
SEQ = 120

# ------------------------------------------------------------------ bars

cte("x_days", """
 SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS date, l_linestatus AS status,
  first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity,
        l_extendedprice) AS o0,
  last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity,
        l_extendedprice) AS c0,
  max(l_extendedprice / l_quantity) AS h0, min(l_extendedprice / l_quantity) AS l0,
  sum(l_quantity) AS v0, round(sum(l_extendedprice), 2) AS turnover, count(*) AS n_trades
 FROM lineitem GROUP BY ALL""")
cte("x_marked", """
 SELECT *, (k % 25 = 4 AND year(date) = 1995) AS artifact,
  (k % 25 = 7 AND year(date) = 1997) AS stale FROM x_days""")
cte("x_raw", """
 SELECT k, date,
  CASE WHEN date >= DATE '1996-07-01' AND k % 10 <> 9 THEN
   CASE WHEN k % 7 = 0 AND month(date) = 1 THEN printf('INX%06d', k)
        ELSE printf('INE%06d', k) END END AS isin,
  CASE WHEN status = 'O' THEN printf('S%06d', k) ELSE printf('T%06d', k) END AS symbol,
  CASE WHEN k % 20 = 13 THEN 'BE' ELSE 'EQ' END AS series,
  CASE WHEN artifact THEN 0.0::DOUBLE ELSE o0 END AS open,
  CASE WHEN artifact THEN 0.0::DOUBLE WHEN stale THEN greatest(h0, 500) ELSE h0 END AS high,
  CASE WHEN artifact THEN 0.0::DOUBLE WHEN stale THEN least(l0, 500) ELSE l0 END AS low,
  CASE WHEN stale THEN 500.0::DOUBLE ELSE c0 END AS close,
  CASE WHEN stale THEN 500.0::DOUBLE ELSE c0 END AS prev_close,
  CASE WHEN stale THEN 500.0::DOUBLE ELSE c0 END AS last,
  CASE WHEN k % 5 = 2 AND (k + dayofyear(date)) % 8 = 0 THEN 0.0::DOUBLE ELSE v0 END AS volume,
  turnover, n_trades FROM x_marked""")
cte("x_equity", f"""
 SELECT {BARS} FROM x_raw WHERE series = 'EQ' AND close IS NOT NULL AND symbol <> ''""")
cte("x_known", """
 SELECT symbol, isin AS known FROM (
  SELECT symbol, isin, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, isin) AS rn
  FROM x_equity WHERE isin <> '' GROUP BY symbol, isin) WHERE rn = 1""")
cte("x_filled", f"""
 SELECT * REPLACE (coalesce(isin, known, 'SYM:' || symbol) AS isin),
  coalesce(isin, known) IS NULL AS isin_is_symbol_fallback
 FROM (SELECT e.*, m.known FROM x_equity e LEFT JOIN x_known m USING (symbol))""")
cte("x_bars", f"""
 SELECT {BARS}, isin_is_symbol_fallback FROM x_filled
 QUALIFY row_number() OVER (PARTITION BY isin, date ORDER BY symbol NULLS FIRST,
  series NULLS FIRST, open NULLS FIRST, high NULLS FIRST, low NULLS FIRST, close NULLS FIRST,
  prev_close NULLS FIRST, last NULLS FIRST, volume NULLS FIRST, turnover NULLS FIRST,
  n_trades NULLS FIRST) = 1""")
cte("x_calendar", "SELECT DISTINCT date FROM x_bars")

# ------------------------------------------------------------------ corporate actions

cte("x_parts", """
 SELECT p_partkey, p_size, p_partkey AS i,
  p_partkey % (SELECT count(*) FROM supplier) AS k,
  DATE '1995-03-01' + CAST(p_partkey * 37 % 2300 AS INTEGER) AS d
 FROM part""")
cte("x_feed_main", """
 SELECT i, printf('INE%06d', k) AS isin, printf('S%06d', k) AS symbol,
  CASE WHEN p_size % 10 = 0 THEN 'BE' ELSE 'EQ' END AS series,
  CASE WHEN i % 23 = 0 THEN '-' WHEN i % 29 = 0 THEN 'junk'
       ELSE strftime(d, '%d-%b-%Y') END AS exDate,
  CASE i % 9 WHEN 0 THEN 'Bonus 1:1'
   WHEN 1 THEN 'Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 2/- Per Share'
   WHEN 2 THEN 'Interim Dividend - Rs 6 Per Share'
   WHEN 3 THEN 'Scheme Of Arrangement - Bonus Debentures 1:1'
   WHEN 4 THEN 'Bonus issue'
   WHEN 5 THEN 'Bonus 1:1/Face Value Split - From Rs 10/- Per Share To Rs 5/- Per Share'
   WHEN 6 THEN 'Annual General Meeting / Dividend - Rs 3/- Per Share / Bonus - 1:2'
   WHEN 7 THEN 'Consolidation From Re 1 To Rs 10' ELSE 'Demerger' END AS subject
 FROM x_parts""")
cte("x_feed", """
 SELECT isin, symbol, series, exDate, subject FROM x_feed_main
 UNION ALL SELECT isin, symbol, 'EQ', exDate, 'Bonus 1:2' FROM x_feed_main WHERE i % 6 = 0""")
cte("x_captured", r"""
 SELECT *,
  try_cast(nullif(regexp_extract(subject, '(?i)bonus\D{0,15}?(\d+)\s*:\s*(\d+)', 1), '') AS DOUBLE) AS bx,
  try_cast(nullif(regexp_extract(subject, '(?i)bonus\D{0,15}?(\d+)\s*:\s*(\d+)', 2), '') AS DOUBLE) AS b_y,
  try_cast(nullif(regexp_extract(subject, '(?i)from\s+rs\.?\s*(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS f_old,
  try_cast(nullif(regexp_extract(subject, '(?i)to\s+r[se]\.?\s*(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS f_new
 FROM x_feed""")
cte("x_multiplied", """
 SELECT isin, symbol, series, exDate, subject,
  CASE WHEN regexp_matches(lower(subject),
        'debenture|demerger|merger|scheme of arrangement|amalgamat') THEN NULL
   WHEN NOT (coalesce(bx > 0 AND b_y > 0, false) OR coalesce(f_old > 0 AND f_new > 0, false))
   THEN NULL
   ELSE (CASE WHEN bx > 0 AND b_y > 0 THEN b_y / (bx + b_y) ELSE 1.0::DOUBLE END)
      * (CASE WHEN f_old > 0 AND f_new > 0 THEN f_new / f_old ELSE 1.0::DOUBLE END)
  END AS multiplier,
  CAST(try_strptime(trim(exDate), '%d-%b-%Y') AS DATE) AS ex_date
 FROM x_captured""")
cte("x_actions", "SELECT isin, symbol, series, ex_date, subject, multiplier FROM x_multiplied "
                 "WHERE ex_date IS NOT NULL")
cte("x_unparsed", """
 SELECT isin, symbol, series, ex_date, subject FROM x_actions
 WHERE series = 'EQ' AND multiplier IS NULL
  AND regexp_matches(lower(subject), 'bonus|split|sub-divi|sub divi|consolidat')""")
cte("x_day_factor", """
 SELECT isin, ex_date, product(multiplier) AS m FROM x_actions
 WHERE series = 'EQ' AND multiplier IS NOT NULL GROUP BY isin, ex_date""")
cte("x_factors", """
 SELECT isin, ex_date, list_reduce(list(m) OVER (PARTITION BY isin ORDER BY ex_date DESC
   ROWS UNBOUNDED PRECEDING), lambda a, b: a * b) AS cum_factor FROM x_day_factor""")
cte("x_adjusted", """
 SELECT b.*, coalesce((SELECT arg_min(f.cum_factor, f.ex_date) FROM x_factors f
   WHERE f.isin = b.isin AND f.ex_date > b.date), 1.0::DOUBLE) AS adj_factor FROM x_bars b""")
cte("x_curated", """
 SELECT *, open * adj_factor AS open_adj, high * adj_factor AS high_adj,
  low * adj_factor AS low_adj, close * adj_factor AS close_adj FROM x_adjusted""")

# ------------------------------------------------------------------ quality

cte("x_streaks", """
 SELECT isin, max(n) AS max_stale_streak FROM (
  SELECT isin, run, count(*) AS n FROM (
   SELECT isin, sum(changed) OVER (PARTITION BY isin ORDER BY date) AS run FROM (
    SELECT isin, date, CASE WHEN close = lag(close) OVER (PARTITION BY isin ORDER BY date)
      THEN 0 ELSE 1 END AS changed FROM x_bars))
  GROUP BY isin, run) GROUP BY isin""")
cte("x_spans", """
 SELECT isin, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_sessions,
  arg_max(symbol, date) AS symbol,
  count(*) FILTER (WHERE volume = 0) AS n_zero_volume,
  count(*) FILTER (WHERE close <= 0) AS n_nonpositive_close,
  count(*) FILTER (WHERE high < low OR high < open OR high < close OR low > open OR low > close)
   AS n_ohlc_violations
 FROM x_bars GROUP BY isin""")
cte("x_expected", """
 SELECT s.isin, count(*) AS expected_sessions FROM x_spans s
 JOIN x_calendar c ON c.date BETWEEN s.first_date AND s.last_date GROUP BY s.isin""")
cte("x_quality", """
 SELECT isin, symbol, first_date, last_date, n_sessions, n_zero_volume, n_nonpositive_close,
  n_zero_volume / n_sessions AS zero_volume_fraction, expected_sessions,
  expected_sessions - n_sessions AS missing_sessions, n_ohlc_violations, max_stale_streak
 FROM x_spans JOIN x_expected USING (isin) JOIN x_streaks USING (isin)""")
cte("x_failing", """
 SELECT * FROM x_quality WHERE n_sessions >= 20 AND (zero_volume_fraction > 0.10
  OR n_nonpositive_close > 0 OR n_ohlc_violations > 0 OR max_stale_streak > 15)""")

# ------------------------------------------------------------------ universe

cte("x_liquid", """
 SELECT isin, avg(turnover) AS adv_inr, arg_max(symbol, date) AS symbol,
  count(date) AS n_sessions, (SELECT max(date) FROM x_curated) AS as_of_date
 FROM x_curated WHERE date <= (SELECT max(date) FROM x_curated)
  AND date > (SELECT max(date) FROM x_curated) - 584 AND series = 'EQ'
 GROUP BY isin HAVING avg(turnover) > 3e4 AND count(date) >= 60""")

# ------------------------------------------------------------------ features

_LN = "CASE WHEN {0} > 0 THEN ln({0}) END"
cte("x_logs", f"""
 SELECT isin, date, volume, ln(volume + 1) AS log_vol,
  {_LN.format('close_adj')} AS lc, {_LN.format('open_adj')} AS lo,
  {_LN.format('high_adj')} AS lh, {_LN.format('low_adj')} AS ll FROM x_curated""")
cte("x_returns", """
 SELECT isin, date, log_vol, lc - lag(lc) OVER w AS ret_1, lo - lag(lc) OVER w AS ret_o,
  lh - lag(lc) OVER w AS ret_h, ll - lag(lc) OVER w AS ret_l,
  lead(lc) OVER w - lc AS fwd_ret_1, row_number() OVER w AS rn, lead(date) OVER w AS next_date
 FROM x_logs WINDOW w AS (PARTITION BY isin ORDER BY date)""")
cte("x_rolling", """
 SELECT *,
  CASE WHEN count(ret_1) OVER v >= 20 THEN stddev_samp(ret_1) OVER v END AS realized_vol_20,
  CASE WHEN count(log_vol) OVER b >= 63 THEN quantile_cont(log_vol, 0.5) OVER b END
   AS log_vol_baseline,
  CASE WHEN count(log_vol) OVER b >= 63 THEN stddev_samp(log_vol) OVER b END AS log_vol_std
 FROM x_returns WINDOW
  v AS (PARTITION BY isin ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY isin ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
_WHEEL = ", ".join(
    f"{fn}({pos} * 2 * pi() / {period}) AS {name}_{fn}"
    for name, pos, period in (("dow", "isodow(date)", 7), ("dom", "day(date)", 31),
                              ("month", "month(date)", 12))
    for fn in ("sin", "cos"))
cte("x_features", f"""
 SELECT *, ret_1 / (realized_vol_20 + 1e-8) AS ret_1_volscaled,
  (log_vol - log_vol_baseline) / (log_vol_std + 1e-8) AS vol_z, {_WHEEL},
  rn > 60 AS has_sufficient_history FROM x_rolling""")

# ------------------------------------------------------------------ samples

_MISSING = " OR ".join(f"{c} IS NULL" for c in FEATURES)


def _state(source: str, window: bool = False) -> str:
    win = (f", list([{', '.join(FEATURES)}]) OVER (PARTITION BY isin ORDER BY date "
           f"ROWS BETWEEN {SEQ - 1} PRECEDING AND CURRENT ROW) AS win") if window else ""
    return f"""
 SELECT *, row_number() OVER (PARTITION BY isin ORDER BY date) - 1 AS array_idx,
  sum(CASE WHEN {_MISSING} THEN 1 ELSE 0 END) OVER (PARTITION BY isin ORDER BY date
   ROWS BETWEEN {SEQ - 1} PRECEDING AND CURRENT ROW) AS bad_rows {win} FROM {source}"""


_USABLE = (f"array_idx >= {SEQ - 1} AND has_sufficient_history AND bad_rows = 0 "
           "AND fwd_ret_1 IS NOT NULL")
_SAMPLE = f"isin, date AS feature_end_date, next_date AS label_date, array_idx"
cte("x_state", _state("x_features"))
cte("x_samples", f"SELECT {_SAMPLE}, ret_1, fwd_ret_1 FROM x_state "
                 f"WHERE {_USABLE} AND next_date IS NOT NULL")
cte("x_wide", _state("x_features", window=True))
cte("x_windows", f"SELECT {_SAMPLE}, win, fwd_ret_1 FROM x_wide "
                 f"WHERE {_USABLE} AND next_date IS NOT NULL")
cte("x_members", "SELECT * FROM x_features WHERE isin IN (SELECT isin FROM x_liquid)")
cte("x_member_state", _state("x_members", window=True))
cte("x_valid", f"SELECT * FROM x_member_state WHERE {_USABLE}")
cte("x_member_days", """
 SELECT date, lead(date) OVER (ORDER BY date) AS label_date
 FROM (SELECT DISTINCT date FROM x_members)""")
cte("x_panels", """
 SELECT v.date AS feature_end_date, d.label_date, v.isin, v.array_idx,
  v.next_date AS target_date, v.fwd_ret_1 AS target, n.n_names, v.win
 FROM x_valid v JOIN x_member_days d ON d.date = v.date AND d.label_date IS NOT NULL
 JOIN (SELECT date, count(*) AS n_names FROM x_valid GROUP BY date) n
  ON n.date = v.date AND n.n_names >= 5""")


def digest(values: str) -> str:
    return (f"md5(array_to_string(list_transform({values}, "
            "lambda v: CAST(round(v * 1e6) AS BIGINT)), ','))")


# ------------------------------------------------------------------ walk-forward

cte("x_folds", """
 SELECT CAST(y AS VARCHAR) AS fold, make_date(y, 1, 1) AS test_start,
  make_date(y, 12, 31) AS test_end FROM (VALUES (1998), (1999), (2000), (2001)) t(y)""")
_TEST = "feature_end_date >= test_start AND label_date <= test_end"
cte("x_assigned", f"""
 SELECT f.fold, CASE WHEN label_date < test_start - 10 THEN 'train' ELSE 'test' END AS split, s.*
 FROM x_samples s JOIN x_folds f ON label_date < test_start - 10 OR ({_TEST})""")
cte("x_panel_assigned", f"""
 SELECT f.fold, CASE WHEN greatest(label_date, target_date) < test_start - 10 AND target_date IS NOT NULL THEN 'train' ELSE 'test' END AS split,
  p.isin, p.feature_end_date, p.label_date, p.target, t.ret_1
 FROM x_panels p JOIN x_returns t ON t.isin = p.isin AND t.date = p.feature_end_date
 JOIN x_folds f ON (greatest(label_date, target_date) < test_start - 10 AND target_date IS NOT NULL) OR ({_TEST})""")
cte("x_test_rows", "SELECT fold, isin, label_date AS date, ret_1, fwd_ret_1 AS actual "
                   "FROM x_assigned WHERE split = 'test'")
cte("x_ar1", """
 SELECT fold, regr_slope(fwd_ret_1, ret_1) AS slope, regr_intercept(fwd_ret_1, ret_1) AS icept
 FROM x_assigned WHERE split = 'train' GROUP BY fold""")
cte("x_forecast", "SELECT fold, isin, date, icept + slope * ret_1 AS pred, actual "
                  "FROM x_test_rows JOIN x_ar1 USING (fold)")
cte("x_preds", "SELECT fold, isin, date, round(pred, 10) AS pred, round(actual, 10) AS actual "
               "FROM x_forecast")
_LEVELS = ", ".join(f"0.{i}" for i in range(1, 10))
cte("x_levels", f"""
 SELECT fold, quantile_cont(fwd_ret_1, [{_LEVELS}]) AS q
 FROM x_assigned WHERE split = 'train' GROUP BY fold""")
cte("x_gap_levels", f"""
 SELECT fold, quantile_cont(fwd_ret_1, [{_LEVELS}]) AS q
 FROM x_assigned WHERE split = 'train' AND dayofmonth(feature_end_date) NOT IN (5, 6) GROUP BY fold""")
cte("x_quantiles", "SELECT fold, isin, date, actual, q FROM x_test_rows JOIN x_levels USING (fold)")
cte("x_pinball", f"""
 SELECT fold, i, lv, greatest((lv - 1) * (actual - q[i]), lv * (actual - q[i])) AS loss
 FROM x_quantiles, (SELECT unnest(range(1, 10)) AS i,
  unnest([{_LEVELS}]::DOUBLE[]) AS lv)""")


def _positions(deadzone: str, source: str = "x_preds") -> str:
    return (f"SELECT *, CASE WHEN abs(pred) > {deadzone} THEN sign(pred)::DOUBLE "
            f"ELSE 0.0::DOUBLE END AS position FROM {source}")


def _book(source: str, keys: str, order: str) -> str:
    return f"""
 SELECT *, abs(position - prev_position) AS turnover, position * actual AS gross_pnl,
  abs(position - prev_position) * 0.001 AS cost,
  position * actual - abs(position - prev_position) * 0.001 AS net_pnl FROM (
   SELECT *, coalesce(lag(position) OVER (PARTITION BY {keys} ORDER BY {order}), 0.0::DOUBLE)
    AS prev_position FROM {source})"""


cte("x_pos", _positions("0.002"))
cte("x_pos_all", _positions("0"))
cte("x_gaps", "SELECT * REPLACE (CASE WHEN dayofyear(date) % 7 <> 3 AND dayofyear(date) % 11 <> 5 "
              "THEN pred END AS pred) FROM x_preds")
cte("x_pos_gaps", _positions("0.002", "x_gaps"))
cte("x_median", "SELECT fold, isin, date, q[5] AS pred, actual FROM x_quantiles")
cte("x_pos_median", _positions("0", "x_median"))
cte("x_book_median", _book("x_pos_median", "fold, isin", "date"))
cte("x_book_gaps", _book("x_pos_gaps", "fold, isin", "date"))
cte("x_book", _book("x_pos", "fold, isin", "date"))
cte("x_book_pooled", _book("x_pos", "fold", "isin, date"))
cte("x_book_all", _book("x_pos_all", "fold, isin", "date"))


def sharpe(x: str) -> str:
    return (f"CASE WHEN count({x}) >= 2 AND stddev_samp({x}) > 0 "
            f"THEN sqrt(252) * avg({x}) / stddev_samp({x}) ELSE 0.0 END")


def hit(deadzone: str) -> str:
    return f"avg(CASE WHEN abs(pred) > {deadzone} THEN (sign(pred) = sign(actual))::INT END)"


def _ranks(source: str, keys: str) -> str:
    def one(c: str) -> str:
        return (f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER "
                f"(PARTITION BY {keys}, {c}) - 1) / 2.0 AS {c}_rank")
    return f"SELECT *, {one('pred')}, {one('actual')} FROM {source}"


def _ic(source: str, keys: str) -> str:
    return f"""
 SELECT {keys}, count(*) AS n_names, CASE WHEN count(*) >= 3 AND min(pred) < max(pred)
   AND min(actual) < max(actual) THEN covar_samp(pred_rank, actual_rank)
   / (stddev_samp(pred_rank) * stddev_samp(actual_rank)) END AS ic
 FROM {source} GROUP BY {keys}"""


def _summary(source: str, keys: str) -> str:
    return f"""
 SELECT {keys}, avg(ic) AS mean_ic, CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic)
   WHEN count(ic) > 0 THEN 0.0 END AS ic_ir, avg((round(ic, 12) > 0)::INT) AS pct_positive_days,
  count(ic) AS n_days FROM {source} GROUP BY {keys}"""


cte("x_ranks", _ranks("x_preds", "fold, date"))
cte("x_ic", _ic("x_ranks", "fold, date"))
cte("x_summary", _summary("x_ic", "fold"))
cte("x_gate", """
 SELECT avg(mean_ic) AS overall_mean_ic, bool_and(mean_ic > 0) OR bool_and(mean_ic < 0)
  AS stable_sign, avg(mean_ic) > 0.02 AND (bool_and(mean_ic > 0) OR bool_and(mean_ic < 0))
  AS gate_pass FROM x_summary""")
cte("x_flat", "SELECT fold, isin, date, CASE WHEN fold >= '2000' THEN 0.001 ELSE pred END AS pred, "
              "actual FROM x_preds")
cte("x_flat_ranks", _ranks("x_flat", "fold, date"))
cte("x_flat_ic", _ic("x_flat_ranks", "fold, date"))
cte("x_year_rows", "SELECT year(date) AS year, date, round(ret_1, 10) AS pred, "
                   "round(fwd_ret_1, 10) AS actual FROM x_features "
                   "WHERE ret_1 IS NOT NULL AND fwd_ret_1 IS NOT NULL")
cte("x_year_ranks", _ranks("x_year_rows", "year, date"))
cte("x_year_ic", _ic("x_year_ranks", "year, date"))
cte("x_year_summary", _summary("x_year_ic", "year"))
_BACKTEST = (f"fold, count(*) AS n, {r(sharpe('gross_pnl'), 'gross_sharpe')}, "
             f"{r(sharpe('net_pnl'), 'net_sharpe')}, {{hit}}, "
             f"{r('avg(abs(position))', 'mean_abs_position')}, "
             f"{r('avg(turnover)', 'avg_turnover_per_day')}")

# ------------------------------------------------------------------ calendar planning

cte("x_on_disk", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem "
                 "WHERE day(l_shipdate) % 3 = 0")
cte("x_holidays", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders "
                  "WHERE day(o_orderdate) % 7 = 0")
cte("x_plan", """
 SELECT date, CASE WHEN date IN (SELECT date FROM x_on_disk) THEN 'skipped_existing'
  WHEN date IN (SELECT date FROM x_holidays) THEN 'skipped_holiday' ELSE 'pending' END AS status
 FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY))
        AS DATE) AS date FROM orders) WHERE isodow(date) <= 5""")
cte("x_log", """
 SELECT CAST(ts AS DATE) AS date, ts, CASE event_type WHEN 'error' THEN 'error'
  WHEN 'view' THEN 'holiday' ELSE 'ok' END AS status FROM events""")

# ------------------------------------------------------------------ queries

_READ = ("date, isin, symbol, series, open, high, low, close, "
         "CASE WHEN k % 11 = 5 THEN NULL ELSE prev_close END AS prev_close, "
         "CASE WHEN k % 13 = 6 THEN NULL ELSE last END AS last, volume, turnover, "
         "CASE WHEN date >= DATE '1996-07-01' THEN n_trades END AS n_trades")
_ADJUSTED = "isin, date, adj_factor, open_adj, high_adj, low_adj, close_adj"
_SPLIT = "fold, split, isin, feature_end_date, label_date"
_PNL = "gross_pnl, cost, net_pnl"
_Q9 = ", ".join(r(f"q[{i}]", f"q{i}") for i in range(1, 10))
_QUALITY = ("isin, symbol, first_date, last_date, n_sessions, n_zero_volume, "
            f"n_nonpositive_close, {r('zero_volume_fraction', dp=9)}, expected_sessions, "
            "missing_sessions, n_ohlc_violations, max_stale_streak")

_FINAL = {
    "read_bars": f"SELECT {_READ} FROM x_raw",
    "read_bars_csv": f"SELECT {_READ} FROM x_raw",
    "read_bars_zips": f"SELECT {_READ} FROM x_raw",
    "read_bars_zip_stream": f"SELECT {_READ} FROM x_raw",
    "quarantine_bad_files":
        "SELECT CAST(min(date) AS VARCHAR) || '_0_bad.zip' AS file, true AS has_error "
        "FROM x_raw GROUP BY year(date)",
    "ingest_stats": "SELECT count(DISTINCT year(date)) AS years, count(DISTINCT date) AS days, "
                    "count(*) AS rows FROM x_raw",
    "write_by_year": "SELECT year(date) AS year, count(*) AS n_rows, min(date) AS first_date, "
                     "max(date) AS last_date, round(sum(turnover), 2) AS turnover FROM x_raw "
                     "GROUP BY year(date)",
    "load_bars": f"SELECT {BARS} FROM x_raw",
    "scan_curated": "SELECT isin, date, close, close_adj, adj_factor FROM x_curated WHERE "
                    "date BETWEEN DATE '1997-03-01' AND DATE '1999-09-30' AND series = 'EQ'",
    "read_actions": "SELECT isin, symbol, series, ex_date, subject FROM x_actions",
    "read_index_membership":
        "SELECT DATE '2001-12-31' AS as_of_date, c_mktsegment AS index, c_name AS symbol, "
        "printf('INE%06d', c_custkey) AS isin, c_name AS company_name, "
        "CAST(c_nationkey AS VARCHAR) AS industry, 'EQ' AS series FROM customer",
    "union_frames": "SELECT isin, symbol, series, ex_date, subject FROM x_actions",
    "pending_sessions": "SELECT date FROM x_plan WHERE status = 'pending'",
    "session_status_counts": "SELECT status, count(*) AS n FROM x_plan GROUP BY status",
    "fetch_log_status":
        "SELECT date, status, n_attempts, n_errors, status = 'error' AS pending FROM ("
        "SELECT date, coalesce(first(status ORDER BY ts, status) FILTER (WHERE status <> 'error'), "
        "'error') AS status, count(*) AS n_attempts, "
        "count(*) FILTER (WHERE status = 'error') AS n_errors FROM x_log GROUP BY date)",
    "ingest_incremental": f"SELECT {_READ} FROM x_raw",
    "write_review_queue": "SELECT * FROM x_unparsed",
    "select_equity_rows": "SELECT * FROM x_equity",
    "backfill_isin": f"SELECT {BARS}, isin_is_symbol_fallback FROM x_filled",
    "dedupe_bars": "SELECT * FROM x_bars",
    "tradable_range":
        "SELECT isin, arg_max(symbol, date) AS last_symbol, "
        "array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols_seen, "
        "min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_sessions, "
        "bool_or(isin_is_symbol_fallback) AS isin_is_symbol_fallback FROM x_bars GROUP BY isin",
    "trading_calendar": "SELECT date FROM x_calendar",
    "action_multiplier": "SELECT isin, exDate, series, subject, multiplier FROM x_multiplied",
    "unparsed_actions": "SELECT * FROM x_unparsed",
    "adjustment_factors": "SELECT * FROM x_factors",
    "apply_adjustment": f"SELECT {_ADJUSTED} FROM x_curated",
    "apply_adjustment_scan": f"SELECT {_ADJUSTED} FROM x_curated",
    "build_curated": f"SELECT {BARS}, isin_is_symbol_fallback, adj_factor, open_adj, high_adj, "
                     "low_adj, close_adj FROM x_curated",
    "build_curated_stats":
        "SELECT count(*) AS rows, count(DISTINCT year(date)) AS years, "
        "count(DISTINCT isin) AS isins, (SELECT count(*) FROM x_factors) AS n_adjustment_events "
        "FROM x_bars",
    "ohlc_violations":
        "SELECT isin, date, open, high, low, close FROM x_bars WHERE high < low OR high < open "
        "OR high < close OR low > open OR low > close",
    "stale_streaks": "SELECT * FROM x_streaks",
    "expected_sessions": "SELECT isin, first_date, last_date, n_sessions, expected_sessions, "
                         "missing_sessions FROM x_quality",
    "quality_per_isin": f"SELECT {_QUALITY} FROM x_quality",
    "quality_left_joins": "SELECT isin, n_ohlc_violations, max_stale_streak FROM x_quality",
    "quality_failing": f"SELECT {_QUALITY} FROM x_failing",
    "quality_gate":
        "SELECT (SELECT count(*) FROM x_calendar) AS n_trading_days_in_calendar, "
        "(SELECT min(date) FROM x_calendar) AS calendar_start, "
        "(SELECT max(date) FROM x_calendar) AS calendar_end, count(*) AS n_isins_total, "
        "count(*) FILTER (WHERE n_sessions >= 20) AS n_isins_judged, "
        "(SELECT count(*) FROM x_failing) AS n_isins_failing, "
        "CAST(sum(n_ohlc_violations) AS BIGINT) AS n_ohlc_violations_total, "
        "round(100.0 * (SELECT count(*) FROM x_failing) "
        "/ greatest(count(*) FILTER (WHERE n_sessions >= 20), 1), 3) AS pct_isins_failing, "
        "CASE WHEN sum(n_ohlc_violations) = 0 AND (SELECT count(*) FROM x_failing) "
        "/ greatest(count(*) FILTER (WHERE n_sessions >= 20), 1) < 0.02 THEN 'GREEN' "
        "ELSE 'RED' END AS gate FROM x_quality",
    "liquid_universe": f"SELECT isin, {r('adv_inr', dp=4)}, symbol, n_sessions, as_of_date "
                       "FROM x_liquid",
    "top_liquid": f"SELECT isin, {r('adv_inr', dp=4)}, symbol, n_sessions, as_of_date "
                  "FROM (SELECT * FROM x_liquid ORDER BY x_liquid.adv_inr DESC, isin LIMIT 40)",
    "restrict_to_universe": "SELECT isin, date, close_adj FROM x_curated "
                            "WHERE isin IN (SELECT isin FROM x_liquid)",
    "log_returns": "SELECT isin, date, " + ", ".join(map(r, FEATURES[:4])) + " FROM x_returns",
    "realized_vol": f"SELECT isin, date, {r('realized_vol_20')} FROM x_rolling",
    "volume_baseline": "SELECT isin, date, " + ", ".join(
        map(r, ("log_vol", "log_vol_baseline", "log_vol_std"))) + " FROM x_rolling",
    "scaled_features": "SELECT isin, date, " + ", ".join(map(r, FEATURES[4:6]))
                       + " FROM x_features",
    "forward_return": f"SELECT isin, date, {r('fwd_ret_1')} FROM x_returns",
    "history_flag": "SELECT isin, date, has_sufficient_history FROM x_features",
    "calendar_encoding": "SELECT isin, date, " + ", ".join(map(r, FEATURES[6:]))
                         + " FROM x_features",
    "compute_features": "SELECT isin, date, " + ", ".join(map(r, (*FEATURES, "fwd_ret_1")))
                        + ", has_sufficient_history FROM x_features",
    "compute_features_long": "SELECT isin, date, " + ", ".join(map(r, (*FEATURES, "fwd_ret_1")))
                        + ", has_sufficient_history FROM x_features",
    "sample_index": "SELECT isin, feature_end_date, label_date, array_idx FROM x_samples",
    "sample_windows": "SELECT isin, feature_end_date, label_date, array_idx, len(win) AS n_rows, "
                      f"{digest('flatten(win)')} AS window, {r('fwd_ret_1', 'target')} "
                      "FROM x_windows",
    # 120 rows padded to 126 in patches of 7: the first holds row 1, the last rows 114-120.
    "patchify": "SELECT isin, feature_end_date, 18 AS n_patches, 84 AS patch_len, "
                        f"{r('list_sum(flatten(win[1:1]))', 'first_sum')}, "
                        f"{r('list_sum(flatten(win[114:120]))', 'last_sum')} FROM x_windows",
    "next_market_date": "SELECT * FROM (SELECT date, lead(date) OVER (ORDER BY date) AS next_date "
                        "FROM x_calendar) WHERE next_date IS NOT NULL",
    "panel_index": "SELECT feature_end_date, label_date, isin, array_idx, target_date, "
                   f"{r('target')}, n_names FROM x_panels",
    "panel_tensors":
        "SELECT feature_end_date, label_date, n_names, "
        "CAST(('0x' || md5(isin)[1:7])::INT % 8 AS INT) AS shard, "
        "array_to_string(list(isin ORDER BY isin), ',') AS isins, "
        f"{digest('flatten(flatten(list(win ORDER BY isin)))')} AS windows, "
        f"{digest('list(target ORDER BY isin)')} AS targets FROM x_panels "
        "GROUP BY ALL",
    "yearly_folds": "SELECT DISTINCT CAST(year(date) AS VARCHAR) AS fold, "
                    "make_date(year(date), 1, 1) AS test_start, "
                    "make_date(year(date), 12, 31) AS test_end FROM x_calendar",
    "pending_folds": "SELECT DISTINCT CAST(year(date) AS VARCHAR) AS fold, "
                     "make_date(year(date), 1, 1) AS test_start, "
                     "make_date(year(date), 12, 31) AS test_end FROM x_calendar "
                     "WHERE CAST(year(date) AS VARCHAR) NOT IN (SELECT fold FROM x_preds "
                     "WHERE fold IN ('1998', '1999'))",
    "assign_splits": f"SELECT {_SPLIT} FROM x_assigned",
    "assign_splits_sessions":
        "SELECT f.fold, CASE WHEN label_date < cutoff THEN 'train' ELSE 'test' END AS split, "
        "isin, feature_end_date, label_date FROM x_samples s JOIN (SELECT f.*, "
        "(SELECT min(date) FROM (SELECT date FROM x_calendar c WHERE c.date < f.test_start "
        "ORDER BY date DESC LIMIT 10)) AS cutoff FROM x_folds f) f "
        f"ON label_date < cutoff OR ({_TEST})",
    "filter_split": "SELECT fold, isin, feature_end_date, label_date FROM x_assigned "
                    "WHERE split = 'train' AND fold = '1999'",
    "fold_counts":
        "SELECT fold, n_train, n_test, n_train >= 200 AND n_test >= 20 AS usable FROM ("
        "SELECT fold, count(*) FILTER (WHERE split = 'train') AS n_train, "
        "count(*) FILTER (WHERE split = 'test') AS n_test FROM x_assigned GROUP BY fold)",
    "panel_fold_counts":
        "SELECT fold, n_train, n_test, n_train >= 50 AND n_test >= 5 AS usable FROM ("
        "SELECT fold, count(DISTINCT feature_end_date) FILTER (WHERE split = 'train') AS n_train, "
        "count(DISTINCT feature_end_date) FILTER (WHERE split = 'test') AS n_test "
        "FROM x_assigned GROUP BY fold)",
    "leakage_guard":
        "SELECT fold, isin, feature_end_date, label_date, CAST(test_start - 30 AS DATE) "
        "AS embargo_cutoff FROM x_assigned JOIN x_folds USING (fold) "
        "WHERE split = 'train' AND label_date >= test_start - 30",
    "shuffle_labels":
        f"SELECT t.isin, t.feature_end_date, {r('t.fwd_ret_1', 'fwd_ret_1')}, "
        f"{r('g.fwd_ret_1', 'shuffled_target')} FROM "
        "(SELECT *, row_number() OVER (ORDER BY isin, feature_end_date) AS pos FROM x_samples) t "
        "JOIN (SELECT fwd_ret_1, row_number() OVER (ORDER BY "
        "md5(isin || '|' || CAST(feature_end_date AS VARCHAR) || '|7'), isin, feature_end_date) "
        "AS pos FROM x_samples) g ON g.pos = t.pos",
    "fit_predict_ar1": f"SELECT fold, isin, date, {r('pred')}, {r('actual')} FROM x_forecast",
    "fit_predict_quantiles": f"SELECT fold, isin, date, {r('actual')}, {_Q9} FROM x_quantiles",
    "score_panels":
        "SELECT fold, isin, date, (round(CASE WHEN sd > 0 THEN (ret_1 - mu) / sd END, 6) + 0.0) "
        "AS pred FROM (SELECT *, avg(ret_1) OVER w AS mu, stddev_samp(ret_1) OVER w AS sd "
        "FROM x_test_rows WINDOW w AS (PARTITION BY fold, date))",
    "score_panels_softmax":
        f"SELECT fold, isin, date, {r('exp(v - max(v) OVER w) / sum(exp(v)) OVER w * exp(max(v) OVER w)', 'pred', 9)} "
        "FROM (SELECT *, round(ret_1, 10) AS v FROM x_test_rows) WINDOW w AS (PARTITION BY fold, date)",
    "score_panels_rank":
        f"SELECT fold, isin, date, {r('(rank() OVER (PARTITION BY fold, date ORDER BY v) - 0.5) / count(*) OVER (PARTITION BY fold, date)', 'pred', 9)} "
        "FROM (SELECT *, round(ret_1, 10) AS v FROM x_test_rows)",
    "walk_forward_ar1": f"SELECT fold, isin, date, {r('pred')}, {r('actual')} FROM x_forecast",
    "walk_forward_quantiles":
        f"SELECT fold, isin, date, {r('actual')}, {_Q9} FROM (SELECT fold, isin, label_date AS date, "
        "CASE WHEN dayofmonth(feature_end_date) NOT IN (5, 6) THEN fwd_ret_1 END AS actual FROM x_assigned WHERE split = 'test') "
        "JOIN x_gap_levels USING (fold)",
    "fold_counts_nested":
        "SELECT fold, n_train, n_test, n_train >= 200 AND n_test >= 20 AS usable FROM ("
        "SELECT fold, count(*) FILTER (WHERE split = 'train') AS n_train, "
        "count(*) FILTER (WHERE split = 'test') AS n_test FROM x_assigned GROUP BY fold)",
    "panel_forecasts":
        f"SELECT fold, isin, label_date AS date, {r('icept + slope * ret_1', 'pred')}, {r('target', 'actual')} "
        "FROM x_panel_assigned JOIN (SELECT fold, regr_slope(target, ret_1) AS slope, regr_intercept(target, ret_1) AS icept "
        "FROM x_panel_assigned WHERE split = 'train' GROUP BY fold) USING (fold) "
        "JOIN (SELECT fold FROM x_panel_assigned GROUP BY fold "
        "HAVING count(DISTINCT feature_end_date) FILTER (WHERE split = 'train') >= 50 "
        "AND count(DISTINCT feature_end_date) FILTER (WHERE split = 'test') >= 5) USING (fold) WHERE split = 'test'",
    "fit_gaps":
        f"SELECT fold, {r('regr_slope(fwd_ret_1, ret_1)', 'slope')}, {r('regr_intercept(fwd_ret_1, ret_1)', 'intercept')}, "
        f"{r('quantile_cont(fwd_ret_1, 0.1)', 'q1')}, {r('quantile_cont(fwd_ret_1, 0.5)', 'q5')} "
        "FROM x_assigned WHERE split = 'train' AND dayofmonth(feature_end_date) NOT IN (5, 6) GROUP BY fold",
    "score_panels_by":
        "SELECT fold, isin, date, (round(CASE WHEN sd > 0 THEN (ret_1 - mu) / sd END, 6) + 0.0) "
        "AS pred FROM (SELECT *, avg(ret_1) OVER w AS mu, stddev_samp(ret_1) OVER w AS sd "
        "FROM x_test_rows WINDOW w AS (PARTITION BY fold, date))",
    "sign_backtest_gaps": f"SELECT {_BACKTEST.format(hit=r(hit('0.002'), 'hit_rate'))} "
                          "FROM x_book_gaps GROUP BY fold",
    "sign_backtest_median": f"SELECT {_BACKTEST.format(hit=r(hit('0'), 'hit_rate'))} "
                            "FROM x_book_median GROUP BY fold",
    "rank_ic_gaps": f"SELECT fold, date, n_names, {r('ic')} FROM x_ic WHERE ic IS NOT NULL "
                    "AND dayofyear(date) % 7 <> 3 AND dayofyear(date) % 11 <> 5",
    "signum_deadzone": "SELECT fold, isin, date, position FROM x_pos",
    "backtest_rows": "SELECT fold, isin, date, position, prev_position, turnover, "
                     f"{_PNL} FROM x_book",
    "backtest_rows_pooled": "SELECT fold, isin, date, position, prev_position, turnover, "
                            f"{_PNL} FROM x_book_pooled",
    "sign_backtest": f"SELECT {_BACKTEST.format(hit=r(hit('0.002'), 'hit_rate'))} "
                     "FROM x_book GROUP BY fold",
    "sharpe_ratio": f"SELECT fold, isin, {r(sharpe('actual'), 'sharpe')} FROM x_preds "
                    "GROUP BY fold, isin",
    "hit_rate": f"SELECT fold, isin, {r(hit('0.001'), 'hit_rate')} FROM x_preds "
                "GROUP BY fold, isin",
    "overall_net_sharpe":
        f"SELECT {r('sqrt(252) * avg(net_pnl) / (stddev_samp(net_pnl) + 1e-12)', 'overall_net_sharpe')}"
        f", count(*) AS n_rows, {r('avg(net_pnl)', 'mean_net_pnl', 9)} FROM x_book_all",
    "average_ranks": "SELECT fold, date, isin, pred_rank, actual_rank FROM x_ranks",
    "rank_ic_by_date": f"SELECT fold, date, n_names, {r('ic')} FROM x_ic WHERE ic IS NOT NULL",
    "rank_ic_summary": "SELECT fold, " + ", ".join(
        map(r, ("mean_ic", "ic_ir", "pct_positive_days"))) + ", n_days FROM x_summary",
    "signal_gate": f"SELECT {r('overall_mean_ic')}, stable_sign, gate_pass FROM x_gate",
    "collapse_check":
        f"SELECT fold, {r('stddev_pop(pred)', 'pred_std', 9)}, "
        "(SELECT count(ic) FROM x_flat_ic i WHERE i.fold = p.fold) AS n_days, "
        "(SELECT count(ic) FROM x_flat_ic i WHERE i.fold = p.fold) = 0 AS collapsed "
        "FROM x_flat p GROUP BY fold",
    "mse_loss": f"SELECT fold, {r('avg((pred - actual) * (pred - actual))', 'mse', 9)} "
                "FROM x_preds GROUP BY fold",
    "pinball_loss": f"SELECT fold, {r('avg(loss)', 'pinball', 9)} FROM x_pinball GROUP BY fold",
    "pinball_by_quantile": f"SELECT fold, lv AS quantile, {r('avg(loss)', 'pinball', 9)} "
                           "FROM x_pinball GROUP BY fold, lv",
    "quantile_crossing": "SELECT fold, isin, date FROM x_quantiles WHERE actual < 0 "
                         "AND q[5] > q[4]",
    "evaluation_report":
        "SELECT * FROM (SELECT fold, " + ", ".join(
            map(r, ("mean_ic", "ic_ir", "pct_positive_days"))) + ", n_days FROM x_summary) "
        f"JOIN (SELECT {_BACKTEST.format(hit=r(hit('0'), 'hit_rate'))} FROM x_book_all "
        "GROUP BY fold) USING (fold) JOIN (SELECT fold, "
        f"{r('avg((pred - actual) * (pred - actual))', 'mse', 9)} FROM x_preds GROUP BY fold) "
        f"USING (fold), (SELECT {r('overall_mean_ic')}, stable_sign, gate_pass FROM x_gate)",
    "flagship_rank_ic": "SELECT year, " + ", ".join(
        map(r, ("mean_ic", "ic_ir", "pct_positive_days"))) + ", n_days FROM x_year_summary",
}

_FINAL["quality_report"] = _FINAL["quality_gate"]
_FINAL["index_snapshot"] = _FINAL["read_index_membership"]

ORACLE = {name: sql(final) for name, final in _FINAL.items()}
