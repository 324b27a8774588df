"""DuckDB statements that answer the registered queries over the same tables."""

from __future__ import annotations

from barloom.plans.features import RETURN_FEATURES
from barloom.schema import FEATURES, PRICES, RELATIVE

from .fixtures import RELATED_ROWS, SHIFT, related_columns

OHLCV = (*PRICES, "volume")


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    # + 0.0 turns a negative zero into zero; the shift lets a value between two results not hang on the order of a sum
    return f"round({expr} + {SHIFT} * power(10, -{digits}), {digits}) + 0.0 AS {name or expr}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def _bars(source: str, ticker: str, start: str, price: str, order: str) -> str:
    return f"""(SELECT {ticker} AS ticker, {start} AS ts,
        first({price} ORDER BY {order}) AS open, max({price}) AS high, min({price}) AS low,
        last({price} ORDER BY {order}) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM {source} GROUP BY 1, 2)"""


def event_bars(start: str = "date_trunc('hour', ts)", ticker: str = "event_type") -> str:
    return "bars AS " + _bars("events", ticker, start, "value", "ts, event_id")


def order_bars(start: str = "date_trunc('day', o_orderdate)") -> str:
    return "bars AS " + _bars("orders", "o_orderpriority", start, "o_totalprice", "o_orderdate, o_orderkey")


HOURLY, DAILY = event_bars(), order_bars()
WEEKLY = order_bars("CAST(date_trunc('week', o_orderdate) AS TIMESTAMP)")
MINUTES = event_bars("time_bucket(INTERVAL 1 MINUTE, ts)")
USER_MINUTES = event_bars("time_bucket(INTERVAL 1 MINUTE, ts)", "CAST(user_id AS VARCHAR)")
# bars that do not move from place 400 to 1700
FLAT = MINUTES.replace("bars AS", "moving AS", 1) + """, counted AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS j FROM moving),
  stuck AS (SELECT ticker, close AS v FROM counted WHERE j = 399),
  bars AS (SELECT ticker, ts, """ + ", ".join(
    f"CASE WHEN v IS NOT NULL AND j BETWEEN 400 AND 1700 THEN v ELSE {c} END AS {c}" for c in PRICES
) + """, volume FROM counted LEFT JOIN stuck USING (ticker))"""
BY_USER = event_bars("date_trunc('day', ts)", "event_type || ':' || user_id")

PLACED = """p AS (SELECT *, row_number() OVER t - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n,
    lag(open) OVER t AS po, lag(high) OVER t AS ph, lag(low) OVER t AS pl, lag(close) OVER t AS pc
    FROM bars WINDOW t AS (PARTITION BY ticker ORDER BY ts))"""


def frame(n: int, key: str = "ticker") -> str:
    return f"(PARTITION BY {key} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {frame(n)} = {n} THEN {agg}({c}) OVER {frame(n)} END"


MOVES = f"""{PLACED}, b AS (SELECT *, close - pc AS delta,
    CASE WHEN close > pc THEN close - pc ELSE 0 END AS up,
    CASE WHEN close < pc THEN pc - close ELSE 0 END AS down,
    greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range,
    CASE WHEN high - ph < 0 THEN 0 ELSE high - ph END AS plus_dm,
    CASE WHEN low - pl > 0 THEN 0 ELSE low - pl END AS minus_dm,
    ((close - low) - (high - close)) / nullif(high - low, 0) * volume AS flow
    FROM p)"""

ROLLED = f"""{MOVES}, w AS (SELECT *,
    {full('avg', 'close', 20)} AS sma_20, {full('avg', 'close', 50)} AS sma_50,
    {full('stddev_samp', 'close', 20)} AS sd_20,
    {full('avg', 'up', 14)} AS gain, {full('avg', 'down', 14)} AS loss,
    {full('avg', 'true_range', 14)} AS atr,
    {full('min', 'low', 14)} AS low_14, {full('max', 'high', 14)} AS high_14,
    {full('sum', 'flow', 20)} AS flow_20, {full('sum', 'volume', 20)} AS volume_20,
    sum(coalesce(sign(delta) * volume, 0)) OVER s AS obv,
    sum(coalesce((close / nullif(pc, 0) - 1) * volume, 0)) OVER s AS pvt
    FROM b WINDOW s AS (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING)),
  x AS (SELECT *,
    CASE WHEN loss = 0 THEN CASE WHEN gain > 0 THEN 100 END ELSE 100 - 100 / (1 + gain / loss) END AS rsi,
    sma_20 AS bb_middle, sma_20 + 2 * sd_20 AS bb_upper, sma_20 - 2 * sd_20 AS bb_lower,
    100 * (close - low_14) / nullif(high_14 - low_14, 0) AS pct_k,
    -100 * (high_14 - close) / nullif(high_14 - low_14, 0) AS williams_r,
    flow_20 / nullif(volume_20, 0) AS cmf FROM w),
  k AS (SELECT *, (bb_upper - bb_lower) / nullif(bb_middle, 0) AS bb_width,
    {full('avg', 'pct_k', 3)} AS pct_d FROM x)"""

# one pass for the averages of prices and movements, a second for what builds on them
RECURSED = f"""{MOVES}, e AS (
  SELECT ticker, i, close AS e12, close AS e20, close AS e26,
    CAST(0 AS DOUBLE) AS up_n, CAST(0 AS DOUBLE) AS down_n, CAST(0 AS DOUBLE) AS dm_d,
    true_range AS tr_n, CAST(1 AS DOUBLE) AS tr_d FROM b WHERE i = 0
  UNION ALL
  SELECT b.ticker, b.i, e12 + (b.close - e12) * 2 / 13, e20 + (b.close - e20) * 2 / 21,
    e26 + (b.close - e26) * 2 / 27,
    up_n * 13 / 14 + b.plus_dm, down_n * 13 / 14 + b.minus_dm, dm_d * 13 / 14 + 1,
    tr_n * 13 / 14 + b.true_range, tr_d * 13 / 14 + 1
  FROM e JOIN b ON b.ticker = e.ticker AND b.i = e.i + 1),
  d AS (SELECT *, e12 - e26 AS macd,
    100 * (up_n / nullif(dm_d, 0)) / nullif(tr_n / tr_d, 0) AS plus_di,
    abs(100 * (down_n / nullif(dm_d, 0)) / nullif(tr_n / tr_d, 0)) AS minus_di FROM e),
  dx AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM d),
  f AS (
  SELECT ticker, i, macd AS signal_line, CAST(0 AS DOUBLE) AS dx_n, CAST(0 AS DOUBLE) AS dx_d FROM dx WHERE i = 0
  UNION ALL
  SELECT dx.ticker, dx.i, signal_line + (dx.macd - signal_line) * 2 / 10,
    dx_n * 13 / 14 + coalesce(dx.dx, 0), dx_d * 13 / 14 + CASE WHEN dx.dx IS NULL THEN 0 ELSE 1 END
  FROM f JOIN dx ON dx.ticker = f.ticker AND dx.i = f.i + 1),
  g AS (SELECT b.*, e20 AS ema_20, macd, signal_line, plus_di, minus_di, dx.dx,
    dx_n / nullif(dx_d, 0) AS adx
    FROM b JOIN dx USING (ticker, i) JOIN f USING (ticker, i))"""

ALL_COLUMNS = (
    "sma_20", "sma_50", "ema_20", "rsi", "bb_middle", "bb_upper", "bb_lower", "bb_width", "macd",
    "signal_line", "atr", "pct_k", "pct_d", "williams_r", "obv", "cmf", "pvt",
    "plus_dm", "minus_dm", "plus_di", "minus_di", "dx", "adx",
)
# ROLLED and RECURSED start alike; the shared part is written once
ENRICHED = f"""{RECURSED}{ROLLED[len(MOVES):]}, z AS (
  SELECT k.*, g.ema_20, g.macd, g.signal_line, g.plus_di, g.minus_di, g.dx, g.adx
  FROM k JOIN g USING (ticker, i))"""

_RETURNS = ", ".join(
    f"CASE WHEN i = 0 THEN 0 ELSE ln({c} / nullif({p}, 0)) END AS {c}_return"
    for c, p in zip(PRICES, ("po", "ph", "pl", "pc"))
)


def _filled(cols, source: str = "gaps", to: str = "") -> str:
    down = ", ".join(f"last_value({c} IGNORE NULLS) OVER u AS d_{c}" for c in cols)
    up = ", ".join(f"first({c} ORDER BY ts) FILTER ({c} IS NOT NULL) AS s_{c}" for c in cols)
    put = ", ".join(f"coalesce(d_{c}, s_{c}) AS {c}" for c in cols)
    return f"""{to}down AS (SELECT ticker, ts, {down} FROM {source}
      WINDOW u AS (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING)),
    {to}starts AS (SELECT ticker, {up} FROM {source} GROUP BY ticker),
    {to}filled AS (SELECT ticker, ts, {put} FROM {to}down JOIN {to}starts USING (ticker))"""


FEATURE_ROWS = f"""{ENRICHED}, gaps AS (SELECT ticker, ts, {_RETURNS}, volume,
    {', '.join(c for c in RETURN_FEATURES if not c.endswith('_return') and c != 'volume')} FROM z),
  {_filled(RETURN_FEATURES)}"""


def _robust(source: str, cols) -> str:
    """(ticker, feature, f_min, f_max) of ``source``."""
    each = " UNION ALL ".join(
        f"SELECT ticker, '{c}' AS feature, quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.99) AS hi, "
        f"max(abs({c})) AS m FROM {source} GROUP BY ticker"
        for c in cols
    )
    half = "CASE WHEN m < 1e-8 THEN 0.001 ELSE m END"
    return f"""ranges AS ({each}), params AS (SELECT ticker, feature,
      CASE WHEN hi - lo < 1e-8 THEN -({half}) ELSE lo END AS f_min,
      CASE WHEN hi - lo < 1e-8 THEN {half} ELSE hi END AS f_max FROM ranges)"""


def _scaled_from(source: str, cols, keep: str = "") -> str:
    """Rows of ``source`` with ``cols`` scaled by ``params``."""
    wide = ", ".join(
        f"max(f_min) FILTER (feature = '{c}') AS lo_{c}, max(f_max) FILTER (feature = '{c}') AS hi_{c}" for c in cols
    )
    put = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN "
        f"greatest(least(({c} - lo_{c}) / (hi_{c} - lo_{c} + 1e-8), 10), -10) END AS {c}"
        for c in cols
    )
    return f"""wide AS (SELECT ticker, {wide} FROM params GROUP BY ticker),
      scaled AS (SELECT ticker, ts{keep}, {put} FROM {source} JOIN wide USING (ticker))"""


def _unpivot(select: dict[str, tuple[str, str]], names: tuple[str, str], source: str = "bars") -> str:
    return " UNION ALL ".join(
        f"SELECT ticker, '{c}' AS feature, {r(a, names[0])}, {r(b, names[1])} FROM {source} GROUP BY ticker"
        for c, (a, b) in select.items()
    )


BY_DAY = """dated AS (SELECT *, CAST(ts AS DATE) AS date FROM bars),
  days AS (SELECT ticker, date, avg((open + high + low + close) / 4) AS avg_price,
    last(close ORDER BY ts) AS close, count(*) AS n_bars FROM dated GROUP BY 1, 2),
  ahead AS (SELECT *, lead(date) OVER t AS next_date, lead(avg_price) OVER t AS next_avg,
    lead(n_bars) OVER t AS next_n, lead(close) OVER t AS later_close
    FROM days WINDOW t AS (PARTITION BY ticker ORDER BY date))"""
OPENING = """numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY ts) AS nth FROM dated),
  opened AS (SELECT ticker, date, CASE WHEN count(*) >= 6 THEN avg((open + high + low + close) / 4) END AS opening_avg
    FROM numbered WHERE nth <= 6 GROUP BY 1, 2)"""


def _labelled(min_bars: int) -> str:
    return f"""{BY_DAY}, labelled AS (SELECT dated.*,
    CASE WHEN next_n >= {min_bars} THEN ln(next_avg / ahead.close) ELSE 0 END AS next_return
    FROM dated JOIN ahead USING (ticker, date))"""


def bars_sql(cte: str, where: str = "", tail: str = "FROM bars") -> str:
    return f"WITH {cte} SELECT ticker, ts, {rs(*OHLCV)} {tail} {where}"


def rolled(cte: str, *cols: str) -> str:
    return f"WITH {cte}, {ROLLED} SELECT ticker, ts, {rs(*cols)} FROM k"


def recursed(cte: str, *cols: str) -> str:
    return f"WITH RECURSIVE {cte}, {RECURSED} SELECT ticker, ts, {rs(*cols)} FROM g"


_TREND_TAIL = """, t AS (SELECT *, lag(close, 19) OVER (PARTITION BY ticker ORDER BY ts) AS back FROM k),
  last AS (SELECT *, CASE WHEN n < 20 THEN 'Insufficient data'
    WHEN close > sma_20 AND sma_20 > sma_50 AND rsi > 50 AND (close - back) / nullif(back, 0) > 0 THEN 'Bullish'
    WHEN close < sma_20 AND sma_20 < sma_50 AND rsi < 50 AND (close - back) / nullif(back, 0) < 0 THEN 'Bearish'
    ELSE 'Neutral' END AS trend FROM t WHERE i = n - 1)"""


def trend(cte: str) -> str:
    return f"WITH {cte}, {ROLLED}{_TREND_TAIL} SELECT ticker, ts, {r('close')}, trend FROM last"


_SUMMARY = """s AS (SELECT ticker, max(close) FILTER (i = n - 1) AS last_close,
    coalesce(max(close) FILTER (i = n - 2), max(close) FILTER (i = n - 1)) AS previous_close,
    avg(volume) AS avg_volume, max(high) AS period_high, min(low) AS period_low FROM p GROUP BY ticker),
  card AS (SELECT *, 100 * (last_close - previous_close) / nullif(previous_close, 0) AS change_pct FROM s)"""
_CARD = ("last_close", "previous_close", "change_pct", "avg_volume", "period_high", "period_low")


def summary(cte: str) -> str:
    return f"WITH {cte}, {PLACED}, {_SUMMARY} SELECT ticker, {rs(*_CARD)} FROM card"


_B20 = "(PARTITION BY ticker ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_A20 = "(PARTITION BY ticker ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)"
FLAGS = f"""flags AS (SELECT *,
    coalesce(count(low) OVER {_B20} = 20 AND count(low) OVER {_A20} = 20
      AND low <= min(low) OVER {_B20} AND low <= min(low) OVER {_A20}, false) AS is_support,
    coalesce(count(high) OVER {_B20} = 20 AND count(high) OVER {_A20} = 20
      AND high >= max(high) OVER {_B20} AND high >= max(high) OVER {_A20}, false) AS is_resistance FROM bars),
  levels AS (SELECT DISTINCT ticker, 'support' AS kind, low AS level FROM flags WHERE is_support
    UNION SELECT DISTINCT ticker, 'resistance', high FROM flags WHERE is_resistance)"""
TOP = """highest AS (SELECT *, row_number() OVER (PARTITION BY ticker, kind ORDER BY level DESC) AS nth FROM levels),
  top AS (SELECT ticker, kind, level, CAST(row_number() OVER (PARTITION BY ticker, kind ORDER BY level) AS INTEGER) AS number
    FROM highest WHERE nth <= 3)"""

_ROWS = ", ".join(f"('{t}', '{o}', {k})" for t, o, k in RELATED_ROWS)


def related_to(k: int) -> str:
    return f"""related AS (SELECT * FROM (VALUES {_ROWS}) AS v(ticker, related_ticker, rank) WHERE rank <= {k})"""


_PAIR = "ticker, related_ticker"
_P20 = frame(20, _PAIR)


def paired(k: int) -> str:
    return f"""{related_to(k)}, paired AS (SELECT b.*, r.related_ticker, r.rank,
      o.close AS related_close, o.volume AS related_volume
      FROM bars b JOIN related r USING (ticker) JOIN bars o ON o.ticker = r.related_ticker AND o.ts = b.ts),
    moved AS (SELECT *, close / nullif(lag(close) OVER q, 0) - 1 AS ret,
      related_close / nullif(lag(related_close) OVER q, 0) - 1 AS rel
      FROM paired WINDOW q AS (PARTITION BY {_PAIR} ORDER BY ts)),
    measured AS (SELECT *, related_close / nullif(close, 0) AS price_ratio, rel - ret AS return_difference,
      100 * related_close / nullif(close, 0) AS relative_strength,
      CASE WHEN count(close) OVER {_P20} = 20 THEN covar_samp(close, related_close) OVER {_P20}
        / nullif(stddev_samp(close) OVER {_P20} * stddev_samp(related_close) OVER {_P20}, 0) END AS rolling_correlation,
      related_volume / nullif(volume, 0) AS volume_ratio,
      CASE WHEN count(ret) OVER {_P20} = 20 THEN covar_samp(ret, rel) OVER {_P20}
        / nullif(stddev_samp(ret) OVER {_P20} * stddev_samp(rel) OVER {_P20}, 0)
        * (stddev_samp(rel) OVER {_P20} / nullif(stddev_samp(ret) OVER {_P20}, 0)) END AS beta
      FROM moved)"""


def wide(k: int) -> str:
    cols = ", ".join(
        r(f"max({c}) FILTER (rank = {i})", f"{c}_stock_{i}") for i in range(1, k + 1) for c in RELATIVE
    )
    return f"WITH {HOURLY}, {paired(k)} SELECT ticker, ts, {cols} FROM measured GROUP BY 1, 2 HAVING count(*) = {k}"


def related_sequences(k: int, length: int = 5) -> str:
    """Features joined on time, relative ones filled, scaled between min and max, labelled from the rows that are left."""
    of = range(1, k + 1)
    relative = [f"{c}_stock_{i}" for i in of for c in RELATIVE]
    side = ", ".join(f"max({c}) FILTER (rank = {i}) AS {c}_stock_{i}" for i in of for c in RELATIVE)
    theirs = ", ".join(f"max(f.{c}) FILTER (r.rank = {i}) AS related_{i}_{c}" for i in of for c in RETURN_FEATURES)
    cols = related_columns(k)
    kept = ", ".join(f"q.{c}" for c in cols if c not in relative)
    spread = ", ".join(f"({c} - min({c}) OVER t) / (max({c}) OVER t - min({c}) OVER t + 1e-8) AS {c}" for c in cols)
    return f"""WITH RECURSIVE {HOURLY}, {FEATURE_ROWS}, {paired(k)},
      side AS (SELECT ticker, ts, {side} FROM measured GROUP BY 1, 2 HAVING count(*) = {k}),
      theirs AS (SELECT r.ticker, f.ts, {theirs} FROM related r JOIN filled f ON f.ticker = r.related_ticker GROUP BY 1, 2),
      joined AS (SELECT * FROM filled JOIN side USING (ticker, ts) JOIN theirs USING (ticker, ts)),
      {_filled(relative, "joined", "j")},
      ready AS (SELECT q.ticker, q.ts, {kept}, {", ".join("jfilled." + c for c in relative)}, b.open, b.high, b.low, b.close
        FROM joined q JOIN jfilled USING (ticker, ts) JOIN bars b ON b.ticker = q.ticker AND b.ts = q.ts
        WHERE {" AND ".join(("jfilled." if c in relative else "q.") + c + " IS NOT NULL" for c in cols)}),
      {BY_DAY.replace("FROM bars", "FROM ready")}, {OPENING},
      scaled AS (SELECT ticker, ts, {spread} FROM ready WINDOW t AS (PARTITION BY ticker)),
      labels AS (SELECT d.ticker, d.ts, o.opening_avg AS next_opening_avg,
        CASE WHEN a.next_n >= 2 THEN ln(a.next_avg / a.close) ELSE 0 END AS next_return
        FROM dated d JOIN ahead a USING (ticker, date)
        LEFT JOIN opened o ON o.ticker = d.ticker AND o.date = coalesce(a.next_date, a.date)),
      placed AS (SELECT scaled.*, next_return, next_opening_avg, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS i
        FROM scaled JOIN labels USING (ticker, ts))
      SELECT a.ticker, a.ts, {r('a.next_return', 'next_return')}, CAST(a.next_return <= 0 AS INTEGER) AS sentiment,
        {r('a.next_opening_avg', 'next_opening_avg')}, CAST(s.i - a.i + {length} AS INTEGER) AS step, {', '.join(r('s.' + c, c) for c in cols)}
      FROM placed a JOIN placed s ON s.ticker = a.ticker AND s.i BETWEEN a.i - {length} AND a.i - 1
      WHERE a.i >= {length} AND a.next_opening_avg IS NOT NULL"""


def sequence_sql(lo: int, hi: int, at: str, cte: str = HOURLY) -> str:
    """Steps of the sequences of rows i+lo .. i+hi, shown with the time of row ``at``."""
    return f"""WITH {cte}, {PLACED} SELECT a.ticker, a.ts, CAST(s.i - a.i - ({lo}) AS INTEGER) AS step,
      {r('s.close', 'x')}, {r('s.volume', 'y')} FROM p a JOIN p s ON s.ticker = a.ticker
      AND s.i BETWEEN a.i + ({lo}) AND a.i + ({hi}) WHERE {at}"""


_NAIVE = f"""{PLACED}, naive AS (SELECT ticker, ts, close AS y_true, pc AS y_pred FROM p WHERE i > 0)"""
_METRICS = """signs AS (SELECT *, y_true > lag(y_true) OVER t AS tu, y_pred > lag(y_pred) OVER t AS pu
    FROM naive WINDOW t AS (PARTITION BY ticker ORDER BY ts)),
  scores AS (SELECT ticker, avg((y_true - y_pred) ** 2) AS mse, sqrt(avg((y_true - y_pred) ** 2)) AS rmse,
    avg(abs(y_true - y_pred)) AS mae, avg(CASE WHEN tu = pu THEN 1.0 WHEN tu <> pu THEN 0.0 END) AS directional_accuracy
    FROM signs GROUP BY ticker)"""


def future(cte: str, steps: int, step: str) -> str:
    """The next times: intervals after the last bar that do not fall on a weekend."""
    return f"""{cte}, newest AS (SELECT ticker, max(ts) AS last, last(close ORDER BY ts) AS price FROM bars GROUP BY ticker),
      walked AS (SELECT ticker, price, last + (k * INTERVAL {step}) AS ts FROM newest, range(1, {steps * 10 + 100}) AS w(k)),
      times AS (SELECT ticker, price, ts, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS step
        FROM walked WHERE isodow(ts) < 6 QUALIFY step <= {steps})"""


def _long(cols, source: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT ticker, ts, '{c}' AS series, {r(c, 'value')}{extra} FROM {source}" for c in cols
    )


TREE_ROWS = f"""{WEEKLY}, {FEATURE_ROWS}, {_labelled(1)},
  ahead_of AS (SELECT f.*, l.next_return AS label, row_number() OVER t AS j, count(*) OVER (PARTITION BY f.ticker) AS k
    FROM filled f JOIN labelled l ON l.ticker = f.ticker AND l.ts = f.ts WINDOW t AS (PARTITION BY f.ticker ORDER BY f.ts)),
  kept AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS nth, count(*) OVER (PARTITION BY ticker) AS m
    FROM ahead_of WHERE j < k AND {' AND '.join(f'{c} IS NOT NULL' for c in (*RETURN_FEATURES, 'label'))}),
  train AS (SELECT * FROM kept WHERE nth < floor(0.8 * m)),
  {_robust('train', RETURN_FEATURES)}, {_scaled_from('kept', RETURN_FEATURES, ', label, nth, m')}"""



def related_forecast(steps: int = 3) -> str:
    """A step: what each pair shows, each ticker's return from that, then the pairs with the two new prices."""
    mean = lambda x: f"list_avg({x})"
    products = lambda x, y: f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: ({x}[i] - {mean(x)}) * ({y}[i] - {mean(y)})))"
    moves = lambda x: f"list_transform(range(2, 22), lambda i: {x}[i] / {x}[i - 1] - 1)"
    parts = []
    for k in range(1, steps + 1):
        parts += [
            f"""v{k} AS (SELECT *, a[2:21] AS ta, b[2:21] AS tb, {moves('a')} AS ma, {moves('b')} AS mb FROM l{k - 1})""",
            f"""m{k} AS (SELECT ticker, rank, b[21] / a[21] AS price_ratio, volume_ratio, mb[20] - ma[20] AS return_difference,
              {products('ta', 'tb')} / (sqrt({products('ta', 'ta')}) * sqrt({products('tb', 'tb')})) AS rolling_correlation,
              {products('ma', 'mb')} / {products('ma', 'ma')} AS beta FROM v{k})""",
            f"""r{k} AS (SELECT s.ticker, s.price, s.x, s.y, s.lo, s.hi, 0.01 * s.x - 0.002 * s.y + 0.001 * (f.price_ratio + f.volume_ratio) - 0.003 * g.rolling_correlation
              + 0.004 * (f.beta - g.return_difference) AS r FROM s{k - 1} s JOIN m{k} f ON f.ticker = s.ticker AND f.rank = 1
              JOIN m{k} g ON g.ticker = s.ticker AND g.rank = 2)""",
            f"""s{k} AS (SELECT ticker, price * exp(r) AS price, greatest(least((r - lo) / (hi - lo + 1e-8), 10), -10) AS x, y, lo, hi, r FROM r{k})""",
            f"""l{k} AS (SELECT l.ticker, l.related_ticker, l.rank, list_append(l.a[2:21], p.price) AS a, list_append(l.b[2:21], q.price) AS b, l.volume_ratio
              FROM l{k - 1} l JOIN s{k} p ON p.ticker = l.ticker JOIN s{k} q ON q.ticker = l.related_ticker)""",
        ]
    done = " UNION ALL ".join(f"SELECT ticker, {k} AS step, price, r FROM s{k}" for k in range(1, steps + 1))
    cols = ("open_return", "rsi")
    return f"""WITH RECURSIVE {future(HOURLY, steps, "1 HOUR")}, {ENRICHED}, gaps AS (SELECT ticker, ts, {_RETURNS}, rsi FROM z),
      {_filled(cols)}, {_robust("filled", cols)}, {_scaled_from("filled", cols)}, {related_to(2)},
      common AS (SELECT b.ticker, r.related_ticker, r.rank, b.ts, b.close, b.volume, o.close AS other, o.volume AS other_volume
        FROM bars b JOIN related r USING (ticker) JOIN bars o ON o.ticker = r.related_ticker AND o.ts = b.ts
        QUALIFY row_number() OVER (PARTITION BY b.ticker, r.related_ticker ORDER BY b.ts DESC) <= 21),
      l0 AS (SELECT ticker, related_ticker, rank, list(close ORDER BY ts) AS a, list(other ORDER BY ts) AS b,
        last(other_volume ORDER BY ts) / last(volume ORDER BY ts) AS volume_ratio FROM common GROUP BY ALL HAVING count(*) = 21),
      s0 AS (SELECT n.ticker, n.price, f.open_return AS x, f.rsi AS y, w.lo_open_return AS lo, w.hi_open_return AS hi
        FROM newest n JOIN scaled f ON f.ticker = n.ticker AND f.ts = n.last JOIN wide w ON w.ticker = n.ticker),
      {", ".join(parts)}, done AS ({done})
      SELECT t.ticker, CAST(t.step AS INTEGER) AS step, t.ts, {r("coalesce(d.price, t.price)", "price")},
        CASE WHEN d.price IS NULL THEN 'Neutral' WHEN d.r > 0 THEN 'Bullish' ELSE 'Bearish' END AS sentiment,
        {r("CASE WHEN d.price IS NULL THEN 0.5 ELSE least(abs(d.r), 1.0) END", "confidence")}
      FROM times t LEFT JOIN done d USING (ticker, step) WHERE d.price IS NOT NULL OR t.step = 1"""


STEPS = {"1m": 390, "5m": 78, "15m": 26, "30m": 13, "1h": 6.5, "1d": 1, "5d": 1 / 5, "1wk": 1 / 7, "1mo": 1 / 30}

ORACLE = {
    "related_forecast": related_forecast(),
    "sequence_length": f"""WITH {BY_USER}, counted AS (SELECT ticker, count(*) AS n_bars FROM bars GROUP BY ticker)
      SELECT ticker, n_bars, CAST(least(3, floor(n_bars * 0.2)) AS INTEGER) AS length, least(3, floor(n_bars * 0.2)) < 1 AS too_short FROM counted""",
    "sequences_padded": f"""WITH {USER_MINUTES}, {PLACED}, own AS (SELECT *, least(234, CAST(floor(n * 0.2) AS INTEGER)) AS l FROM p),
      w AS (SELECT greatest(1, max(l)) AS w FROM own)
      SELECT a.ticker, a.ts, CAST(w - a.l AS INTEGER) AS pad, CAST(w + s.i - a.i AS INTEGER) AS step, {r('s.close', 'x')}, {r('s.volume', 'y')}
      FROM own a CROSS JOIN w JOIN p s ON s.ticker = a.ticker AND s.i BETWEEN a.i - a.l AND a.i - 1 WHERE a.i >= a.l AND a.l > 0""",
    "trading_steps": f"""WITH {DAILY}, counted AS (SELECT ticker, count(*) AS n_bars FROM bars GROUP BY ticker),
      given AS (SELECT * FROM (VALUES {", ".join(f"('{i}', {n})" for i, n in STEPS.items())}) AS v("interval", per_day)),
      days AS (SELECT * FROM (VALUES (1), (3), (10)) AS v(days))
      SELECT ticker, n_bars, "interval", CAST(days AS INTEGER) AS days, CAST(greatest(1, trunc(per_day * days)) AS INTEGER) AS steps FROM counted, given, days""",
    "bars_1m": bars_sql(event_bars("time_bucket(INTERVAL 1 MINUTE, ts)")),
    "bars_5m": bars_sql(event_bars("time_bucket(INTERVAL 5 MINUTE, ts)")),
    "bars_15m": bars_sql(event_bars("time_bucket(INTERVAL 15 MINUTE, ts)")),
    "bars_30m": bars_sql(event_bars("time_bucket(INTERVAL 30 MINUTE, ts)")),
    "bars_1h": bars_sql(HOURLY),
    "bars_once": bars_sql(HOURLY),
    "bars_stored": bars_sql(HOURLY),
    "bars_1d": bars_sql(DAILY),
    "bars_5d": bars_sql(order_bars("time_bucket(INTERVAL 5 DAY, o_orderdate, TIMESTAMP '1970-01-01')")),
    "bars_1wk": bars_sql(WEEKLY),
    "bars_1mo": bars_sql(order_bars("CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)")),
    "bars_by_user": bars_sql(BY_USER),
    "roll_up_1d": bars_sql(event_bars("date_trunc('day', ts)")),
    "stream_bars": bars_sql(HOURLY),
    "read_bars": bars_sql(HOURLY),
    "read_bars_range": bars_sql(
        HOURLY, "WHERE ticker IN ('click', 'view', 'error') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'"
    ),
    "candles": bars_sql(HOURLY),
    "period_6mo": bars_sql(
        DAILY, "WHERE ts >= TIMESTAMP '1999-09-17' AND ts < TIMESTAMP '2000-03-16'"
    ),
    "period_ytd": bars_sql(
        DAILY, "WHERE ts >= TIMESTAMP '2000-01-01' AND ts < TIMESTAMP '2000-03-16'"
    ),
    # all ticks are of January, when the market's zone is five hours behind
    "market_hours": bars_sql(
        event_bars("time_bucket(INTERVAL 5 MINUTE, ts)"),
        "WHERE CAST(ts - INTERVAL 5 HOUR AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00'",
    ),
    "weekdays": bars_sql(DAILY, "WHERE isodow(ts) < 6"),
    "enough_bars": f"WITH {BY_USER}, {PLACED} SELECT ticker, ts, {rs(*OHLCV)} FROM p WHERE n >= 5",
    "drop_last_row": f"WITH {HOURLY}, {PLACED} SELECT ticker, ts, {rs(*OHLCV)} FROM p WHERE i < n - 1",
    "related_bars": f"""WITH {HOURLY}, {related_to(3)} SELECT r.ticker, related_ticker, CAST(rank AS INTEGER) AS rank,
      b.ts, {rs(*OHLCV)} FROM related r JOIN bars b ON b.ticker = r.related_ticker""",
    "norm_params_saved": f"WITH {DAILY} "
    + _unpivot({c: (f"min({c})", f"max({c})") for c in OHLCV}, ("f_min", "f_max")),
    "sma": rolled(HOURLY, "sma_20", "sma_50"),
    "ema": recursed(HOURLY, "ema_20"),
    "delta": rolled(HOURLY, "delta"),
    "rsi": rolled(HOURLY, "rsi"),
    "bollinger": rolled(HOURLY, "bb_middle", "bb_upper", "bb_lower", "bb_width"),
    "bollinger_stored": rolled(HOURLY, "bb_middle", "bb_upper", "bb_lower", "bb_width"),
    "macd": recursed(HOURLY, "macd", "signal_line"),
    "true_range": rolled(HOURLY, "true_range"),
    "atr": rolled(HOURLY, "atr"),
    "stochastic": rolled(HOURLY, "pct_k", "pct_d"),
    "williams_r": rolled(HOURLY, "williams_r"),
    "obv": rolled(HOURLY, "obv"),
    "cmf": rolled(WEEKLY, "cmf"),
    "pvt": f"WITH {HOURLY}, {ROLLED} SELECT ticker, ts, {r('pvt', digits=3)} FROM k",
    "adx": recursed(HOURLY, "plus_dm", "minus_dm", "plus_di", "minus_di", "dx", "adx"),
    "adx_flat_stretch": recursed(FLAT, "plus_dm", "minus_dm", "plus_di", "minus_di", "dx", "adx"),
    "log_returns": f"""WITH {HOURLY}, {PLACED}, q AS (SELECT *, {_RETURNS} FROM p)
      SELECT ticker, ts, {rs(*[f'{c}_return' for c in PRICES])} FROM q""",
    "pct_change": f"WITH {HOURLY}, {PLACED} SELECT ticker, ts, {r('close / nullif(pc, 0) - 1', 'pct_change')} FROM p",
    "indicators": f"WITH RECURSIVE {WEEKLY}, {ENRICHED} SELECT ticker, ts, {rs(*ALL_COLUMNS)} FROM z",
    "trend": trend(HOURLY),
    "trend_by_user": trend(USER_MINUTES),
    "level_flags": f"WITH {HOURLY}, {FLAGS} SELECT ticker, ts, {rs(*OHLCV)}, is_support, is_resistance FROM flags",
    "levels": f"WITH {HOURLY}, {FLAGS} SELECT ticker, kind, {r('level')} FROM levels",
    "levels_stored": f"WITH {HOURLY}, {FLAGS} SELECT ticker, kind, {r('level')} FROM levels",
    "levels_top3": f"WITH {HOURLY}, {FLAGS}, {TOP} SELECT ticker, kind, {r('level')}, number FROM top",
    "summary": summary(HOURLY),
    "summary_by_user": summary(BY_USER),
    "data_summary": f"""WITH {HOURLY} SELECT ticker, count(*) AS n_bars, min(ts) AS first_ts, max(ts) AS last_ts
      FROM bars GROUP BY ticker""",
    "last_row": f"WITH {HOURLY}, {PLACED} SELECT ticker, ts, {rs('close', 'volume')} FROM p WHERE i = n - 1",
    "technical_report": f"""WITH RECURSIVE {DAILY}, {ENRICHED}, {_SUMMARY},
      t AS (SELECT *, lag(close, 19) OVER (PARTITION BY ticker ORDER BY ts) AS back FROM z),
      last AS {_TREND_TAIL.split('last AS ')[1]}
      SELECT ticker, ts, {rs(*_CARD, 'close')}, trend, {rs('rsi', 'sma_20', 'ema_20', 'bb_upper', 'bb_lower')}
      FROM card JOIN last USING (ticker)""",
    "relative": f"""WITH {HOURLY}, {paired(5)} SELECT ticker, related_ticker, CAST(rank AS INTEGER) AS rank, ts,
      {rs(*OHLCV, 'related_close', 'related_volume', *RELATIVE)} FROM measured""",
    "relative_wide": wide(3),
    "daily": f"WITH {HOURLY}, {BY_DAY} SELECT ticker, date, {rs('avg_price', 'close')}, n_bars FROM days",
    "trading_dates": f"WITH {HOURLY}, {BY_DAY} SELECT ticker, date, coalesce(next_date, date) AS next_date FROM ahead",
    "opening_average": f"WITH {HOURLY}, {BY_DAY}, {OPENING} SELECT ticker, date, {r('opening_avg')} FROM opened",
    "next_day_opening": f"""WITH {HOURLY}, {BY_DAY}, {OPENING} SELECT d.ticker, d.ts,
      {', '.join(r('d.' + c, c) for c in OHLCV)}, {r('o.opening_avg', 'next_opening_avg')}
      FROM dated d JOIN ahead a USING (ticker, date)
      LEFT JOIN opened o ON o.ticker = d.ticker AND o.date = coalesce(a.next_date, a.date)""",
    "next_day_label": f"""WITH {HOURLY}, {_labelled(2)} SELECT ticker, ts, {rs(*OHLCV, 'next_return')},
      CAST(next_return <= 0 AS INTEGER) AS sentiment FROM labelled""",
    "next_day_label_daily": f"""WITH {DAILY}, {_labelled(1)} SELECT ticker, ts, {rs(*OHLCV, 'next_return')},
      CAST(next_return <= 0 AS INTEGER) AS sentiment FROM labelled""",
    "next_day_close": f"""WITH {HOURLY}, {BY_DAY} SELECT ticker, ts, {', '.join(r('d.' + c, c) for c in OHLCV)},
      {r('coalesce(later_close, a.close)', 'next_close')},
      CAST(coalesce(later_close, a.close) <= d.close AS INTEGER) AS close_sentiment
      FROM dated d JOIN ahead a USING (ticker, date)""",
    "shifted_target": f"""WITH {HOURLY} SELECT ticker, ts, {rs(*OHLCV)},
      {r('lead(close, 3) OVER (PARTITION BY ticker ORDER BY ts)', 'target')} FROM bars""",
    "percentiles": f"WITH {DAILY} "
    + " UNION ALL ".join(
        f"SELECT ticker, '{c}' AS feature, CAST({p} AS DOUBLE) AS prob, {r(f'quantile_cont({c}, {p})', 'value')} "
        "FROM bars GROUP BY ticker"
        for c in ("close", "volume")
        for p in (0.01, 0.99)
    ),
    "minmax_params": f"WITH {HOURLY} "
    + _unpivot({c: (f"min({c})", f"max({c})") for c in OHLCV}, ("f_min", "f_max")),
    "minmax_params_train": f"WITH {HOURLY}, {PLACED}, tr AS (SELECT * FROM p WHERE i < floor(0.8 * n)) "
    + _unpivot({c: (f"min({c})", f"max({c})") for c in ("close", "volume")}, ("f_min", "f_max"), "tr"),
    "zscore_params": f"WITH {HOURLY} "
    + _unpivot({c: (f"avg({c})", f"stddev_pop({c})") for c in OHLCV}, ("mean", "std")),
    "robust_params": f"""WITH {DAILY}, {_robust('bars', OHLCV)}
      SELECT ticker, feature, {rs('f_min', 'f_max')} FROM params""",
    "zscore": f"""WITH {HOURLY} SELECT ticker, ts, {', '.join(
        r(f'({c} - avg({c}) OVER k) / (stddev_pop({c}) OVER k + 1e-8)', c) for c in ('close', 'volume'))}
      FROM bars WINDOW k AS (PARTITION BY ticker)""",
    "minmax": f"""WITH {HOURLY} SELECT ticker, ts, {', '.join(
        r(f'({c} - min({c}) OVER k) / (max({c}) OVER k - min({c}) OVER k + 1e-8)', c) for c in ('close', 'volume'))}
      FROM bars WINDOW k AS (PARTITION BY ticker)""",
    "robust_scale": f"""WITH {DAILY}, {_robust('bars', ('close', 'volume'))},
      {_scaled_from('bars', ('close', 'volume'))} SELECT ticker, ts, {rs('close', 'volume')} FROM scaled""",
    "robust_scale_train": f"""WITH {DAILY}, {PLACED}, train AS (SELECT * FROM p WHERE i < floor(0.8 * n)),
      {_robust('train', ('close', 'volume'))}, {_scaled_from('bars', ('close', 'volume'))}
      SELECT ticker, ts, {rs('close', 'volume')} FROM scaled""",
    "unscale_minmax": f"WITH {HOURLY} SELECT ticker, ts, {rs('close', 'volume')} FROM bars",
    # undoing leaves out the eps that scaling adds: a difference far below two digits
    "unscale": f"WITH {HOURLY} SELECT ticker, ts, {r('close', digits=2)} FROM bars",
    "ffill_bfill": f"""WITH {WEEKLY}, {ROLLED}, gaps AS (SELECT ticker, ts, sma_50, cmf FROM k),
      {_filled(('sma_50', 'cmf'))} SELECT ticker, ts, {rs('sma_50', 'cmf')} FROM filled""",
    "fill_constant": f"WITH {HOURLY}, {ROLLED} SELECT ticker, ts, {r('coalesce(rsi, 0)', 'rsi')} FROM k",
    "null_report": f"WITH RECURSIVE {WEEKLY}, {ENRICHED}, counted AS ("
    + " UNION ALL ".join(
        f"SELECT ticker, '{c}' AS feature, count(*) - count({c}) AS n_null FROM z GROUP BY ticker" for c in FEATURES
    )
    + ") SELECT * FROM counted WHERE n_null > 0",
    "split": f"WITH {HOURLY}, {PLACED} SELECT ticker, ts, {rs(*OHLCV)}, i < floor(0.8 * n) AS is_train FROM p",
    "sequences_labelled": sequence_sql(-5, -1, "a.i >= 5"),
    "sequences_sliding": sequence_sql(0, 4, "a.i + 4 < a.n"),
    "sequences_latest": sequence_sql(-4, 0, "a.i = a.n - 1 AND a.n >= 5"),
    "sequences_latest_long": sequence_sql(-1199, 0, "a.i = a.n - 1 AND a.n >= 1200", MINUTES),
    "metrics": f"""WITH {DAILY}, {_NAIVE}, {_METRICS}
      SELECT ticker, {', '.join(r(c, digits=2) for c in ('mse', 'rmse', 'mae', 'directional_accuracy'))} FROM scores""",
    "combined_loss": f"""WITH {HOURLY}, {_labelled(2)}, guessed AS (SELECT *,
        1 / (1 + exp((close - open) / close)) AS p FROM labelled),
      lost AS (SELECT ticker, avg((next_return - 0.01) ** 2) AS mse,
        avg(-ln(greatest(CASE WHEN next_return <= 0 THEN p ELSE 1 - p END, 1e-15))) AS log_loss FROM guessed GROUP BY ticker)
      SELECT ticker, {rs('mse', 'log_loss')}, {r('mse + log_loss', 'loss')} FROM lost""",
    "confidence": f"""WITH {DAILY}, {_NAIVE}, {_METRICS}, judged AS (SELECT naive.*,
        (y_true - y_pred) / nullif(sqrt(mse), 0) AS c FROM naive JOIN scores USING (ticker))
      SELECT ticker, ts, CASE WHEN c > 0.5 THEN 'Bullish' WHEN c < -0.5 THEN 'Bearish' ELSE 'Uncertain' END AS direction,
      {r('abs(coalesce(c, 0))', 'score')} FROM judged""",
    "confidence_percent": f"""WITH {DAILY}, {_NAIVE}, judged AS (SELECT *, 100 * (y_true - y_pred) / nullif(y_pred, 0) AS c FROM naive)
      SELECT ticker, ts, CASE WHEN c > 0.5 THEN 'Bullish' WHEN c < -0.5 THEN 'Bearish' ELSE 'Uncertain' END AS direction,
      {r('abs(c)', 'score')} FROM judged""",
    "features": f"WITH RECURSIVE {WEEKLY}, {FEATURE_ROWS} SELECT ticker, ts, {rs(*RETURN_FEATURES)} FROM filled",
    "scaled_features": f"""WITH RECURSIVE {WEEKLY}, {FEATURE_ROWS}, {_robust('filled', RETURN_FEATURES)},
      {_scaled_from('filled', RETURN_FEATURES)} SELECT ticker, ts, {rs(*RETURN_FEATURES)} FROM scaled""",
    "training_sequences": f"""WITH RECURSIVE {HOURLY}, {FEATURE_ROWS}, {_robust('filled', RETURN_FEATURES)},
      {_scaled_from('filled', RETURN_FEATURES)}, {_labelled(2)},
      placed AS (SELECT scaled.*, next_return, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS i,
        count(*) OVER (PARTITION BY ticker) AS n FROM scaled JOIN (SELECT ticker, ts, next_return FROM labelled) USING (ticker, ts)),
      whole AS (SELECT ticker FROM filled GROUP BY ticker HAVING {' AND '.join(
          f'count({c}) = count(*)' for c in RETURN_FEATURES)})
      SELECT a.ticker, a.ts, {r('a.next_return', 'next_return')}, CAST(a.next_return <= 0 AS INTEGER) AS sentiment,
      CAST(s.i - a.i + 5 AS INTEGER) AS step, {', '.join(r('s.' + c, c) for c in RETURN_FEATURES)}
      FROM placed a JOIN placed s ON s.ticker = a.ticker AND s.i BETWEEN a.i - 5 AND a.i - 1
      WHERE a.i >= 5 AND a.i < a.n - 1 AND a.ticker IN (SELECT ticker FROM whole)""",
    "related_sequences": related_sequences(2),
    "tree_rows_return": f"""WITH RECURSIVE {TREE_ROWS}
      SELECT ticker, ts, {r('label')}, nth < floor(0.8 * m) AS is_train, {rs(*RETURN_FEATURES)} FROM scaled""",
    # three steps, each from the scaled return of the one before
    "forecast_fixed": f"""WITH RECURSIVE {TREE_ROWS},
      newest AS (SELECT ticker, max(ts) AS last, last(close ORDER BY ts) AS close FROM bars GROUP BY ticker),
      state AS (SELECT f.ticker, n.close, {', '.join(
          f'greatest(least((f.{c} - w.lo_{c}) / (w.hi_{c} - w.lo_{c} + 1e-8), 10), -10) AS {k}'
          for c, k in (('open_return', 'x0'), ('rsi', 'y')))}, w.lo_open_return AS lo, w.hi_open_return AS hi
        FROM filled f JOIN newest n ON n.ticker = f.ticker AND n.last = f.ts JOIN wide w ON w.ticker = f.ticker
        WHERE {' AND '.join(f'f.{c} IS NOT NULL' for c in RETURN_FEATURES)}),
      {', '.join(
          f"r{k} AS (SELECT *, 0.02 * x{k - 1} - 0.01 * y AS p{k}, greatest(least((0.02 * x{k - 1} - 0.01 * y - lo) / (hi - lo + 1e-8), 10), -10) AS x{k} FROM {'state' if k == 1 else f'r{k - 1}'})"
          for k in (1, 2, 3))},
      done AS ({' UNION ALL '.join(
          f"SELECT ticker, {k} AS step, close * exp({' + '.join(f'p{j}' for j in range(1, k + 1))}) AS price, p{k} AS p FROM r3" for k in (1, 2, 3))}),
      walked AS (SELECT ticker, close, last + (k * INTERVAL 1 DAY) AS ts FROM newest, range(1, 30) AS w(k)),
      times AS (SELECT ticker, close, ts, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS step FROM walked WHERE isodow(ts) < 6 QUALIFY step <= 3)
      SELECT t.ticker, CAST(t.step AS INTEGER) AS step, t.ts, {r('coalesce(d.price, t.close)', 'price')},
        CASE WHEN d.price IS NULL THEN 'Neutral' WHEN p > 0 THEN 'Bullish' ELSE 'Bearish' END AS sentiment,
        {r('CASE WHEN d.price IS NULL THEN 0.5 ELSE least(abs(p), 1.0) END', 'confidence')}
      FROM times t LEFT JOIN done d USING (ticker, step) WHERE d.price IS NOT NULL OR t.step = 1""",
    "uncovered": f"WITH RECURSIVE {DAILY}, {FEATURE_ROWS} "
    + " UNION ALL ".join(f"SELECT ticker, '{c}' AS feature FROM filled GROUP BY ticker HAVING count({c}) = 0" for c in RETURN_FEATURES),
    "tree_rows_close": f"""WITH RECURSIVE {WEEKLY}, {ENRICHED}, ready AS (SELECT *,
        lead(close) OVER (PARTITION BY ticker ORDER BY ts) AS label FROM z),
      kept AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS nth,
        count(*) OVER (PARTITION BY ticker) AS m FROM ready
        WHERE {' AND '.join(f'{c} IS NOT NULL' for c in (*FEATURES, 'label'))})
      SELECT ticker, ts, {rs('label', 'close', 'rsi')}, nth < floor(0.8 * m) AS is_train,
      CAST({len(FEATURES)} AS INTEGER) AS width FROM kept""",
    "future_times": f"WITH {future(DAILY, 7, '1 DAY')} SELECT ticker, CAST(step AS INTEGER) AS step, ts FROM times",
    "chart_feed": f"""WITH {future(HOURLY, 3, '1 HOUR')}, {FLAGS}, {TOP},
      ends AS (SELECT ticker, max(last) AS a, max(ts) AS b FROM times JOIN newest USING (ticker) GROUP BY ticker)
      {_long(PRICES, 'bars')}
      UNION ALL SELECT ticker, ts, 'forecast', {r('price', 'value')} FROM times
      UNION ALL SELECT ticker, a, kind || '_' || number, {r('level', 'value')} FROM top JOIN ends USING (ticker)
      UNION ALL SELECT ticker, b, kind || '_' || number, {r('level', 'value')} FROM top JOIN ends USING (ticker)""",
    "overlay_feed": f"""WITH RECURSIVE {HOURLY}, {ENRICHED}, l AS ({_long((*PRICES, 'sma_20', 'ema_20', 'bb_upper', 'bb_lower', 'rsi'), 'z')})
      SELECT *, CASE WHEN series <> 'rsi' THEN NULL WHEN value > 70 THEN 'overbought'
        WHEN value < 30 THEN 'oversold' ELSE 'between' END AS rsi_zone FROM l WHERE value IS NOT NULL""",
    "final_change": f"""WITH {future(HOURLY, 3, '1 HOUR')} SELECT ticker, CAST(step AS INTEGER) AS step, ts,
      {r('price * 1.03', 'price')}, 'Bullish' AS sentiment, CAST(0.5 AS DOUBLE) AS confidence,
      {r('price', 'current_price')}, {r('100 * (price * 1.03 - price) / nullif(price, 0)', 'change_pct')}
      FROM times WHERE step = 3""",
}
