"""The same answers in DuckDB SQL, stated independently from definitions."""

from __future__ import annotations

from latentia.functions.expr import DAY, MU1, SECOND, normal_gate
from latentia.plans import catalogue as c

EVENTS = "SELECT event_type AS symbol, epoch_us(ts) AS us, event_id AS seq, value AS price FROM events WHERE value > 0"
ORDERS = "SELECT o_orderpriority AS symbol, epoch_us(o_orderdate) AS us, o_orderkey AS seq, o_totalprice AS price FROM orders WHERE o_totalprice > 0"
BY = "PARTITION BY symbol ORDER BY"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def last(width: int, offset: int = 0) -> str:
    at = f"(us - {offset}) // {width}"
    return f"SELECT symbol, {at} AS bin, price, count(*) OVER (PARTITION BY symbol, {at}) AS n FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol, {at} ORDER BY us DESC, seq DESC) = 1"


def returns(width: int, ticks: str = EVENTS) -> str:
    """CTEs ticks, last_bars, bars (gap filled), ret (symbol, bin, price, r)."""
    return f"""ticks AS ({ticks}), last_bars AS ({last(width)}),
      spans AS (SELECT symbol, bin, price, coalesce(lead(bin) OVER ({BY} bin), bin + 1) AS nxt FROM last_bars),
      bars AS (SELECT symbol, unnest(range(bin, nxt)) AS bin, price FROM spans),
      ret AS (SELECT symbol, bin, price, ln(price) - ln(lag(price) OVER ({BY} bin)) AS r FROM bars)"""


H, M10 = returns(c.HOUR), returns(c.MINUTES_10)
DAILY = f"""{M10},
      rv AS (SELECT symbol, bin // 144 AS day, coalesce(sum(r * r), 0) AS rv FROM ret GROUP BY ALL),
      extent AS (SELECT symbol, us // {DAY} AS day, ln(max(price) / min(price)) AS intraday_range FROM ticks GROUP BY ALL),
      daily AS (SELECT * FROM rv LEFT JOIN extent USING (symbol, day))"""


def pairs(ticks: str) -> str:
    w = f"OVER ({BY} us, seq)"
    return f"""ticks AS ({ticks}), one AS (SELECT *, ln(price) - ln(lag(price) {w}) AS r, lag(us) {w} AS us1, lag(us, 2) {w} AS us2 FROM ticks),
      pairs AS (SELECT *, lag(r) {w} AS r1 FROM one)"""


def roll(by: str, where: str = "TRUE", least: int = 2) -> str:
    return f"""SELECT {by}, count(*) AS n_pairs, CASE WHEN count(*) >= {least} THEN -covar_samp(r, r1) END AS r_noise,
        CASE WHEN count(*) < {least} THEN 'too_few' WHEN -covar_samp(r, r1) <= 0 THEN 'not_positive' ELSE 'ok' END AS status
      FROM pairs WHERE r IS NOT NULL AND r1 IS NOT NULL AND {where} GROUP BY {by}"""


def rolled(by: str, inner: str) -> str:
    return f"SELECT {by}, n_pairs, {r('r_noise', 'r_noise')}, status FROM ({inner})"


def at(text: str) -> str:
    return f"epoch_us(TIMESTAMP '{text}')"


PERIOD = f"CASE WHEN us < {at(c.EVENT)} THEN 'pre' WHEN us < {at(c.EVENT)} + 4 * {DAY} THEN 'during' ELSE 'post' END"
STATES = f"{H}, states AS (SELECT symbol, bin, CAST(abs(r) > 1 AS INTEGER) AS state FROM ret WHERE r IS NOT NULL), tick_state AS (SELECT t.*, coalesce(s.state, -1) AS state FROM ticks t LEFT JOIN states s ON s.symbol = t.symbol AND s.bin = t.us // {c.HOUR})"
ROLLING = f"{BY} bin ROWS BETWEEN 5 PRECEDING AND CURRENT ROW"
RATE = f"{H}, rate AS (SELECT symbol, bin, price, r, sum(r * r) OVER ({ROLLING}) / 21600.0 AS rv_rate FROM ret WHERE r IS NOT NULL)"
BIPOWER = f"""{M10},
      lagged AS (SELECT symbol, bin // 144 AS day, r, abs(r) AS a0, abs(lag(r) OVER w) AS a1, abs(lag(r, 2) OVER w) AS a2 FROM ret WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol, bin // 144 ORDER BY bin)),
      sums AS (SELECT symbol, day, count(*) AS n, sum(r * r) AS rv, pi() / 2 * sum(a0 * a1) AS bv, count(*) * {MU1**-3!r} * sum(pow(a0 * a1 * a2, 4.0 / 3)) AS tq FROM lagged GROUP BY ALL HAVING count(*) >= 10),
      days AS (SELECT symbol, day, n, rv, bv, greatest(rv - bv, 0) AS jump, CASE WHEN rv > 0 THEN greatest(rv - bv, 0) / rv END AS jump_share,
        CASE WHEN bv > 0 AND tq > 0 AND rv > 0 THEN (rv - bv) / rv / sqrt((pow(pi() / 2, 2) + pi() - 5) * greatest(1, tq / (bv * bv)) / n) END AS z_stat FROM sums)"""
WINDOWS = f"""{DAILY},
      runs AS (SELECT symbol, day AS start_day, max(day) OVER w AS end_day, count(*) OVER w AS m, sum(rv) OVER w AS total_rv, max(rv) OVER w AS max_daily_rv, max(intraday_range) OVER w AS max_range FROM daily WINDOW w AS ({BY} day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))"""
KALMAN = f"""RECURSIVE {RATE},
      series AS (SELECT symbol, bin, ln(price) AS z, rv_rate * 3600 AS q, row_number() OVER ({BY} bin) AS i FROM rate),
      k AS (
        SELECT symbol, bin, i, z AS x, ({c.R_NOISE} + q) * (1 - ({c.R_NOISE} + q) / ({c.R_NOISE} + q + {c.R_NOISE})) AS p, 0.0::DOUBLE AS y, {c.R_NOISE} + q + {c.R_NOISE} AS s FROM series WHERE i = 1
        UNION ALL
        SELECT n.symbol, n.bin, n.i, k.x + (k.p + n.q) / (k.p + n.q + {c.R_NOISE}) * (n.z - k.x), (k.p + n.q) * {c.R_NOISE} / (k.p + n.q + {c.R_NOISE}), n.z - k.x, k.p + n.q + {c.R_NOISE} FROM k JOIN series n ON n.symbol = k.symbol AND n.i = k.i + 1
      )"""


def imm() -> str:
    """Two modes written out."""
    (q0, q1), (r0, r1), ((a, b), (d, e)) = c.MODES_Q, c.MODES_R, c.MODES_PI
    start = (r0 + r1) / 2

    def step(x0: str, x1: str, p0: str, p1: str, m0: str, m1: str, source: str) -> str:
        return f"""
        SELECT symbol, bin, i, xa, xb, pa, pb, la / (la + lb) AS m0, lb / (la + lb) AS m1 FROM (
          SELECT symbol, bin, i, ua + ga / sa * (z - ua) AS xa, ub + gb / sb * (z - ub) AS xb, (1 - ga / sa) * ga AS pa, (1 - gb / sb) * gb AS pb,
            ca * exp(-(z - ua) * (z - ua) / (2 * sa)) / sqrt(2 * pi() * sa) AS la, cb * exp(-(z - ub) * (z - ub) / (2 * sb)) / sqrt(2 * pi() * sb) AS lb FROM (
            SELECT symbol, bin, i, z, ca, cb, ua, ub, va + {q0} AS ga, vb + {q1} AS gb, va + {q0} + {r0} AS sa, vb + {q1} + {r1} AS sb FROM (
              SELECT *, w00 * (p0 + (x0 - ua) * (x0 - ua)) + w10 * (p1 + (x1 - ua) * (x1 - ua)) AS va, w01 * (p0 + (x0 - ub) * (x0 - ub)) + w11 * (p1 + (x1 - ub) * (x1 - ub)) AS vb FROM (
                SELECT *, w00 * x0 + w10 * x1 AS ua, w01 * x0 + w11 * x1 AS ub FROM (
                  SELECT *, {a} * m0 / ca AS w00, {d} * m1 / ca AS w10, {b} * m0 / cb AS w01, {e} * m1 / cb AS w11 FROM (
                    SELECT *, {a} * m0 + {d} * m1 AS ca, {b} * m0 + {e} * m1 AS cb FROM (
                      SELECT n.symbol, n.bin, n.i, n.z, {x0} AS x0, {x1} AS x1, {p0} AS p0, {p1} AS p1, {m0} AS m0, {m1} AS m1 FROM {source}
                    ))))))) """

    first = step("n.z", "n.z", f"{start}::DOUBLE", f"{start}::DOUBLE", "0.5::DOUBLE", "0.5::DOUBLE", "series n WHERE n.i = 1")
    more = step("k.xa", "k.xb", "k.pa", "k.pb", "k.m0", "k.m1", "k JOIN series n ON n.symbol = k.symbol AND n.i = k.i + 1")
    return f"""RECURSIVE {H}, series AS (SELECT symbol, bin, ln(price) AS z, row_number() OVER ({BY} bin) AS i FROM ret), k AS ({first} UNION ALL {more}),
      est AS (SELECT symbol, bin, m0 * xa + m1 * xb AS x, m0, m1, xa, xb, pa, pb FROM k),
      imm AS (SELECT symbol, bin, x AS x_filt, m0 * (pa + (xa - x) * (xa - x)) + m1 * (pb + (xb - x) * (xb - x)) AS p_filt, m1 AS elevated_prob FROM est)"""


def imm_of(k: int) -> str:
    """CTEs k, imm: k modes written out; needs CTEs ret and given (symbol, q0.., r0.., a00.., e0.. in {0, 1})."""
    modes = range(k)
    each = lambda f, sep=", ": sep.join(f(j) for j in modes)
    keep = "symbol, bin, i"
    par = ", ".join([*[f"q{j}" for j in modes], *[f"r{j}" for j in modes], *[f"a{i}{j}" for i in modes for j in modes]])

    def step(x: str, p: str, m: str, source: str) -> str:
        state = each(lambda j: f"{x.format(j)} AS x{j}, {p.format(j)} AS p{j}, {m.format(j)} AS m{j}")
        mixed = lambda j, f: " + ".join(f"a{i}{j} * m{i} / c{j} * ({f(i)})" for i in modes)
        return f"""
        SELECT {keep}, {each(lambda j: f"x{j}, p{j}, CASE WHEN t > 0 AND isfinite(t) THEN l{j} / t ELSE c{j} END AS m{j}")} FROM (
          SELECT *, {each(lambda j: f"l{j}", " + ")} AS t FROM (
            SELECT {keep}, {each(lambda j: f"c{j}, u{j} + g{j} / s{j} * (z - u{j}) AS x{j}, (1 - g{j} / s{j}) * g{j} AS p{j}, c{j} * exp(-(z - u{j}) * (z - u{j}) / (2 * s{j})) / sqrt(2 * pi() * s{j}) AS l{j}")} FROM (
              SELECT *, {each(lambda j: f"v{j} + q{j} AS g{j}, v{j} + q{j} + r{j} AS s{j}")} FROM (
                SELECT *, {each(lambda j: mixed(j, lambda i: f"p{i} + (x{i} - u{j}) * (x{i} - u{j})") + f" AS v{j}")} FROM (
                  SELECT *, {each(lambda j: mixed(j, lambda i: f"x{i}") + f" AS u{j}")} FROM (
                    SELECT *, {each(lambda j: "greatest(" + " + ".join(f"a{i}{j} * m{i}" for i in modes) + f", 1e-300) AS c{j}")} FROM (
                      SELECT n.symbol, n.bin, n.i, n.z, {", ".join("n." + c for c in par.split(", "))}, {state} FROM {source}
                    )))))))"""

    n_positive = each(lambda j: f"CAST(n.r{j} > 0 AS INTEGER)", " + ")
    start = f"(CASE WHEN {n_positive} > 0 THEN ({each(lambda j: f'greatest(n.r{j}, 0)', ' + ')}) / ({n_positive}) ELSE 1e-8 END)::DOUBLE"
    first = step("n.z", start, f"{1 / k}::DOUBLE", "series n WHERE n.i = 1")
    more = step("k.x{0}", "k.p{0}", "k.m{0}", "k JOIN series n ON n.symbol = k.symbol AND n.i = k.i + 1")
    return f"""series AS (SELECT ret.symbol, bin, ln(price) AS z, row_number() OVER (PARTITION BY ret.symbol ORDER BY bin) AS i, {par} FROM ret JOIN given ON given.symbol = ret.symbol),
      k AS ({first} UNION ALL {more}),
      est AS (SELECT *, {each(lambda j: f"m{j} * x{j}", " + ")} AS x FROM k),
      imm AS (SELECT est.symbol, bin, x AS x_filt, {each(lambda j: f"m{j} * (p{j} + (x{j} - x) * (x{j} - x))", " + ")} AS p_filt, {each(lambda j: f"m{j} * e{j}", " + ")} AS elevated_prob FROM est JOIN given ON given.symbol = est.symbol)"""


def given_sql(q: list[float], r: list[float], pi: list[list[float]], elevated: set[int]) -> str:
    """CTE given of constants."""
    named = [(f"q{j}", x) for j, x in enumerate(q)] + [(f"r{j}", x) for j, x in enumerate(r)] + [(f"a{i}{j}", x) for i, row in enumerate(pi) for j, x in enumerate(row)] + [(f"e{j}", int(j in elevated)) for j in range(len(q))]
    return f"given AS (SELECT DISTINCT symbol, {', '.join(f'{x!r}::DOUBLE AS {n}' for n, x in named)} FROM ret)"


def observed() -> str:
    """CTEs st, reg (a row per symbol and state), wide and given: regimes by the size of returns and their parameters."""
    k = len(c.EDGES) + 1
    state = " + ".join(f"CAST(abs(r) >= {e} AS INTEGER)" for e in c.EDGES)
    prev = f"OVER ({BY} us, seq)"
    column = lambda f, name: ", ".join(f"max({f}) FILTER (reg.state = {j}) AS {name}{j}" for j in range(k))
    return f"""st AS (SELECT symbol, bin, r, {state} AS state FROM ret WHERE r IS NOT NULL),
      every AS (SELECT symbol, state FROM (SELECT DISTINCT symbol FROM st), (SELECT unnest(range({k})) AS state)),
      var AS (SELECT symbol, state, var_pop(r) AS variance FROM st GROUP BY ALL),
      moved AS (SELECT symbol, lag(state) OVER ({BY} bin) AS i, state AS j FROM st),
      left_n AS (SELECT symbol, i, count(*) + {k} AS n FROM moved WHERE i IS NOT NULL GROUP BY ALL),
      pi AS (
        SELECT a.symbol, a.state AS i, b.state AS j, (count(moved.j) + 1.0) / coalesce(any_value(left_n.n), {k}) AS p FROM every a JOIN every b ON a.symbol = b.symbol
        LEFT JOIN moved ON moved.symbol = a.symbol AND moved.i = a.state AND moved.j = b.state LEFT JOIN left_n ON left_n.symbol = a.symbol AND left_n.i = a.state GROUP BY a.symbol, a.state, b.state
      ),
      tick_at AS (SELECT ticks.*, coalesce(state, -1) AS state FROM ticks LEFT JOIN st ON st.symbol = ticks.symbol AND st.bin = ticks.us // {c.HOUR}),
      one AS (SELECT *, ln(price) - ln(lag(price) {prev}) AS r, lag(state) {prev} AS s1, lag(state, 2) {prev} AS s2 FROM tick_at),
      two AS (SELECT *, lag(r) {prev} AS r1 FROM one),
      noise AS (SELECT symbol, state, count(*) AS n_pairs, CASE WHEN count(*) >= {c.LEAST_PAIRS} THEN -covar_samp(r, r1) END AS r_noise FROM two WHERE r IS NOT NULL AND r1 IS NOT NULL AND state >= 0 AND state = s1 AND s1 = s2 GROUP BY ALL),
      base AS (SELECT e.symbol, e.state, coalesce(variance, 0) AS variance, coalesce(n_pairs, 0) AS n_pairs, greatest(coalesce(r_noise, 0), 0) AS r_noise FROM every e LEFT JOIN var USING (symbol, state) LEFT JOIN noise USING (symbol, state)),
      reg AS (
        SELECT base.*, greatest(variance - 2 * r_noise, 1e-15) AS q, variance > median(variance) OVER (PARTITION BY base.symbol) AS elevated, pi.p AS stays
        FROM base JOIN pi ON pi.symbol = base.symbol AND pi.i = base.state AND pi.j = base.state
      ),
      rows_pi AS (SELECT symbol, {", ".join(f"max(p) FILTER (i = {i} AND j = {j}) AS a{i}{j}" for i in range(k) for j in range(k))} FROM pi GROUP BY symbol),
      given AS (SELECT reg.symbol, {column('q', 'q')}, {column('r_noise', 'r')}, {column('CAST(elevated AS INTEGER)', 'e')}, {", ".join(f"any_value(a{i}{j}) AS a{i}{j}" for i in range(k) for j in range(k))} FROM reg JOIN rows_pi ON rows_pi.symbol = reg.symbol GROUP BY reg.symbol)"""


SCORED = f"{H}, scored AS (SELECT symbol, bin, price / (price + 25) AS elevated_prob, stddev_samp(r) OVER ({ROLLING}) AS rolling_vol FROM ret WHERE r IS NOT NULL)"
AHEAD = f"OVER ({BY} bin ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)"
LABELLED = f"{SCORED}, ahead AS (SELECT symbol, bin, CASE WHEN count(elevated_prob) {AHEAD} = 6 THEN avg(elevated_prob) {AHEAD} END AS forward_mean FROM scored), labelled AS (SELECT *, CAST(forward_mean > 0.5 AS DOUBLE) AS real_label FROM ahead)"
ROWS = f"ticks AS ({EVENTS}), rows AS (SELECT row_number() OVER (ORDER BY us, seq) - 1 AS pos, us // {DAY} AS day, CAST(symbol = 'purchase' AS DOUBLE) AS y, price / (price + 25) AS p FROM ticks)"
FOLDS = f"""{ROWS}, days AS (SELECT day, min(pos) AS lo, max(pos) AS hi, row_number() OVER (ORDER BY day) - 1 AS fold FROM rows GROUP BY day),
      zones AS (SELECT fold, hi + 1 AS first, hi + {c.EMBARGO} AS stop FROM days WHERE fold >= 1),
      train AS (SELECT f.fold, f.lo, f.hi, t.y FROM days f JOIN rows t ON t.pos < f.lo - {c.PURGE} WHERE f.fold >= 1 AND NOT EXISTS (SELECT 1 FROM zones z WHERE z.fold < f.fold AND t.pos BETWEEN z.first AND z.stop)),
      folds AS (SELECT f.fold, f.lo AS test_lo, f.hi AS test_hi, count(t.y) AS n_train, coalesce(sum(t.y), 0) AS y_train FROM days f LEFT JOIN train t USING (fold) WHERE f.fold >= 1 GROUP BY ALL)"""


def auc(by: str = "") -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH {ROWS}, ranked AS (SELECT *, rank() OVER ({part}ORDER BY p) + (count(*) OVER (PARTITION BY {key}p) - 1) / 2.0 AS mid FROM rows),
      s AS (SELECT {key}CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg, sum(CASE WHEN y = 1 THEN mid END) AS m FROM ranked {group})
      SELECT {key}n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN {"round((m - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 8) + 0.0"} END AS auc FROM s"""


def scores(key: str, rows: str) -> str:
    sel = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""WITH {ROWS}, part AS ({rows}), s AS (SELECT {sel}count(*) AS n, avg(y) AS b, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS l, avg((p - y) * (p - y)) AS q FROM part {group})
      SELECT {sel}n, {r('b', 'base_rate')}, {r('l', 'log_score')}, {r('q', 'brier')}, {r('1 - l / -(b * ln(b) + (1 - b) * ln(1 - b))', 'log_skill')}, {r('1 - q / (b * (1 - b))', 'brier_skill')} FROM s"""


def costs(threshold: float | str) -> str:
    return f"count_if(p > {threshold} AND y = 0) * {c.C_FP} + count_if(p <= {threshold} AND y = 1) * {c.C_FN}"


CURVE = f"{ROWS}, t AS (SELECT unnest({c.THRESHOLDS}::DOUBLE[]) AS threshold), curve AS (SELECT threshold, count_if(p > threshold AND y = 0) AS fp, count_if(p <= threshold AND y = 1) AS fn, ({costs('threshold')}) / count(*) AS mean_cost FROM t, rows GROUP BY threshold)"
STAR = c.C_FP / (c.C_FP + c.C_FN)
PREV = f"OVER ({BY} us, seq)"

SQL: dict[str, str] = {
    "daily_realized_variance": f"WITH {DAILY} SELECT symbol, day, {r('rv', 'rv')}, {r('intraday_range', 'intraday_range')} FROM daily",
    "bars_last": f"WITH ticks AS ({EVENTS}) {last(c.MINUTES_10)}",
    "bars_gapfill": f"WITH {M10} SELECT symbol, bin, price FROM bars",
    "bars_offset": f"WITH ticks AS ({EVENTS}) {last(c.HOUR, 90 * SECOND)}",
    "log_returns": f"WITH {H} SELECT symbol, bin, price, {r('r', 'r')} FROM ret",
    "stale_fraction": f"WITH ticks AS ({ORDERS}), b AS ({last(7 * DAY)}), p AS (SELECT *, lag(price) OVER ({BY} bin) AS prev FROM b) SELECT symbol, count(*) AS n_bins, {r('avg(CAST(price = prev AS INTEGER))', 'stale')} FROM p GROUP BY symbol",
    "arrival_stats": f"WITH ticks AS ({EVENTS}), g AS (SELECT symbol, (us - lag(us) {PREV}) / 1e6 AS gap FROM ticks) SELECT symbol, {r('quantile_cont(gap, 0.5)', 'median_gap', 4)}, {r('avg(gap)', 'mean_gap', 4)}, {r('avg(CAST(gap > 1 AS INTEGER))', 'share_over_1s', 4)}, avg(CAST(gap > 1 AS INTEGER)) > 0.1 AS sparse FROM g GROUP BY symbol",
    "same_ts_share": f"WITH ticks AS ({ORDERS}), g AS (SELECT symbol, coalesce(us = lag(us) {PREV}, FALSE) AS same FROM ticks) SELECT symbol, {r('avg(CAST(same AS INTEGER))', 'same_ts_share')} FROM g GROUP BY symbol",
    "roll_noise": f"WITH {pairs(EVENTS)} {rolled('symbol', roll('symbol'))}",
    "roll_noise_distinct_ts": f"WITH {pairs(ORDERS)} {rolled('symbol', roll('symbol', 'us <> us1 AND us1 <> us2'))}",
    "roll_by_period": f"WITH {pairs(EVENTS).replace('pairs AS (SELECT *,', f'pairs AS (SELECT *, {PERIOD} AS period,')} {rolled('symbol, period', roll('symbol, period'))}",
    "tick_state_join": f"WITH {STATES} SELECT symbol, state, count(*) AS n FROM tick_state GROUP BY ALL",
    "roll_by_state": f"""WITH {STATES}, one AS (SELECT *, ln(price) - ln(lag(price) {PREV}) AS r, lag(state) {PREV} AS s1, lag(state, 2) {PREV} AS s2 FROM tick_state), pairs AS (SELECT *, lag(r) {PREV} AS r1 FROM one)
      {rolled('symbol, state', roll('symbol, state', 'state = s1 AND s1 = s2 AND state >= 0', 100))}""",
    "implied_spread": f"WITH {pairs(EVENTS)}, n AS ({roll('symbol')}) SELECT symbol, {r('CASE WHEN r_noise > 0 THEN 2 * sqrt(r_noise) * 1e4 END', 'spread_bp', 4)} FROM n",
    "regime_invariance_ratio": f"WITH {pairs(EVENTS).replace('pairs AS (SELECT *,', f'pairs AS (SELECT *, {PERIOD} AS period,')}, n AS ({rolled('symbol, period', roll('symbol, period'))}) SELECT symbol, {r('max(CASE WHEN period = $$during$$ THEN r_noise END) / max(CASE WHEN period = $$pre$$ THEN r_noise END)', 'ratio', 4)} FROM n GROUP BY symbol",
    "signature": f"""WITH ticks AS ({EVENTS}), g AS (SELECT w AS width, i * w // 4 AS phase FROM (SELECT unnest([{c.HOUR}, {2 * c.HOUR}]) AS w), (SELECT unnest([0, 1, 2, 3]) AS i)),
      b AS (SELECT symbol, width, phase, (us - phase) // width AS bin, price FROM ticks, g QUALIFY row_number() OVER (PARTITION BY symbol, width, phase, (us - phase) // width ORDER BY us DESC, seq DESC) = 1),
      p AS (SELECT *, lag(price) OVER (PARTITION BY symbol, width, phase ORDER BY bin) AS prev FROM b),
      o AS (SELECT symbol, width, phase, sum(pow(ln(price) - ln(prev), 2)) AS rv, avg(CAST(price = prev AS INTEGER)) AS stale FROM p GROUP BY ALL)
      SELECT symbol, width, {r('avg(rv)', 'rv_mean')}, {r('stddev_pop(rv)', 'rv_std')}, {r('avg(stale)', 'stale')} FROM o GROUP BY ALL""",
    "rolling_rv_rate": f"WITH {RATE} SELECT symbol, bin, {r('rv_rate', 'rv_rate')}, {r('rv_rate * 3600', 'q')} FROM rate",
    "rolling_vol": f"WITH {SCORED} SELECT symbol, bin, {r('rolling_vol', 'rolling_vol')} FROM scored",
    "standardized_returns": f"WITH {H} SELECT symbol, bin, {r('r / stddev_pop(r) OVER (PARTITION BY symbol)', 'z')} FROM ret WHERE r IS NOT NULL",
    "bipower_daily": f"WITH {BIPOWER} SELECT symbol, day, n, {', '.join(r(x, x) for x in c.BIPOWER)} FROM days",
    "jump_flags": f"WITH {BIPOWER} SELECT symbol, count(*) AS n_days, CAST(count_if(coalesce(z_stat > {normal_gate(30)!r}, FALSE)) AS BIGINT) AS n_flagged FROM days GROUP BY symbol",
    "window_summary": f"WITH {WINDOWS} SELECT symbol, start_day, end_day, {r('total_rv', 'total_rv')}, {r('max_daily_rv', 'max_daily_rv')}, {r('max_range', 'max_range')}, {r('max_daily_rv / total_rv', 'largest_share')} FROM runs WHERE m = 7",
    "calmest_windows": f"WITH {WINDOWS} SELECT symbol, start_day, end_day, {r('total_rv', 'total_rv')} FROM runs WHERE m = 7 ORDER BY runs.total_rv, symbol, start_day LIMIT 10",
    "mad_trim": f"""WITH {DAILY}, m AS (SELECT symbol, quantile_cont(rv, 0.5) AS med FROM daily GROUP BY symbol), d AS (SELECT symbol, quantile_cont(abs(rv - med), 0.5) AS mad FROM daily JOIN m USING (symbol) GROUP BY symbol)
      SELECT symbol, day, {r('rv', 'rv')} FROM daily JOIN m USING (symbol) JOIN d USING (symbol) WHERE mad = 0 OR abs(0.6745 * (daily.rv - med) / mad) <= 3.5""",
    "acf_lags": f"""WITH {H}, x AS (SELECT symbol, bin, r - avg(r) OVER (PARTITION BY symbol) AS x FROM ret WHERE r IS NOT NULL), l AS (SELECT unnest([1, 2, 12, 24]) AS lag),
      ss AS (SELECT symbol, sum(x * x) AS ss FROM x GROUP BY symbol)
      SELECT a.symbol, CAST(l.lag AS INTEGER) AS lag, {r('sum(a.x * b.x) / any_value(ss)', 'acf')} FROM x a JOIN l ON TRUE JOIN x b ON b.symbol = a.symbol AND b.bin = a.bin + l.lag JOIN ss ON ss.symbol = a.symbol GROUP BY a.symbol, l.lag""",
    "acf_full": f"""WITH {H}, x AS (SELECT symbol, bin, r - avg(r) OVER (PARTITION BY symbol) AS x FROM ret WHERE r IS NOT NULL), l AS (SELECT unnest(range(49)) AS lag),
      ss AS (SELECT symbol, sum(x * x) AS ss FROM x GROUP BY symbol)
      SELECT a.symbol, CAST(l.lag AS INTEGER) AS lag, {r('sum(a.x * b.x) / any_value(ss)', 'acf')} FROM x a JOIN l ON TRUE JOIN x b ON b.symbol = a.symbol AND b.bin = a.bin + l.lag JOIN ss ON ss.symbol = a.symbol GROUP BY a.symbol, l.lag""",
    "naive_vol_rule": f"WITH {RATE}, e AS (SELECT symbol, bin, rv_rate, quantile_cont(rv_rate, 0.5) OVER ({BY} bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM rate) SELECT symbol, bin, {r('m', 'past_median')}, coalesce(rv_rate > m, FALSE) AS flag FROM e",
    "kalman_filter": f"WITH {KALMAN} SELECT symbol, bin, {r('x', 'x_filt')}, {r('p', 'p_filt')}, {r('y', 'innovation')}, {r('s', 'innovation_var')}, {r('y * y / s', 'gate_stat')} FROM k",
    "kalman_gate_rate": f"WITH {KALMAN}, g AS (SELECT symbol, {PERIOD.replace('us', f'bin * {c.HOUR}').replace(f'epoch_bin * {c.HOUR}', 'epoch_us')} AS period, y * y / s > {c.GATE} AS f FROM k) SELECT symbol, period, count(*) AS n, {r('avg(CAST(f AS INTEGER))', 'flagged')} FROM g GROUP BY ALL",
    "imm_filter": f"WITH {imm()} SELECT symbol, bin, {r('x_filt', 'x_filt')}, {r('p_filt', 'p_filt')}, {r('elevated_prob', 'elevated_prob')} FROM imm",
    "elevated_by_phase": f"""WITH {imm()}, p AS (SELECT symbol, elevated_prob, bin * {c.HOUR} - {at(c.EVENT)} AS us FROM imm), g AS (SELECT symbol, elevated_prob, CASE WHEN us < 0 THEN 'pre' WHEN us < 4 * {DAY} THEN 'early' WHEN us < 10 * {DAY} THEN 'late' END AS phase FROM p)
      SELECT symbol, phase, {r('avg(elevated_prob)', 'persistence')} FROM g WHERE phase IS NOT NULL GROUP BY ALL""",
    "forward_label": f"WITH {LABELLED} SELECT symbol, bin, {r('forward_mean', 'forward_mean')}, real_label FROM labelled",
    "causal_features": f"WITH {SCORED} SELECT symbol, bin, {r('elevated_prob', 'elevated_prob')}, {r(f'lag(elevated_prob) OVER ({BY} bin)', 'elevated_prob_lag1')}, {r('rolling_vol', 'rolling_vol')} FROM scored",
    "circular_null": f"""WITH {LABELLED}, p AS (SELECT symbol, bin, real_label, row_number() OVER ({BY} bin) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM labelled WHERE real_label IS NOT NULL),
      s AS (SELECT unnest({c.SHIFTS}::BIGINT[]) AS s, unnest(range({len(c.SHIFTS)})) AS shift_id)
      SELECT a.symbol, a.bin, CAST(s.shift_id AS INTEGER) AS shift_id, b.real_label AS null_label FROM p a JOIN s ON TRUE JOIN p b ON b.symbol = a.symbol AND b.pos = ((a.pos - s.s) % a.n + a.n) % a.n""",
    "window_union": f"WITH {DAILY} SELECT CASE WHEN day < {at('2024-01-16')} // {DAY} THEN 'first' ELSE 'second' END AS window_id, symbol, day, {r('rv', 'rv')} FROM daily",
    "calendar_gaps": f"WITH ticks AS ({ORDERS}), d AS (SELECT DISTINCT symbol, us // {DAY} AS day FROM ticks), g AS (SELECT symbol, day, day - lag(day) OVER ({BY} day) AS gap_days FROM d) SELECT * FROM g WHERE gap_days > 2",
    "duplicates": f"WITH ticks AS ({ORDERS}) SELECT symbol, us, count(*) AS n, count(*) - 1 AS n_extra FROM ticks GROUP BY ALL HAVING count(*) > 1",
    "kfold_membership": f"WITH {ROWS}, n AS (SELECT count(*) AS n FROM rows) SELECT pos, CAST(len(list_filter([1, 2, 3, 4, 5, 6], lambda i: i * n // 7 <= pos)) AS BIGINT) AS fold FROM rows, n",
    "walkforward_folds": f"WITH {FOLDS} SELECT * FROM folds",
    "dummy_oof": f"WITH {FOLDS} SELECT rows.pos, f.fold, rows.y AS y_true, {r('f.y_train / f.n_train', 'y_pred')} FROM rows JOIN folds f ON rows.pos BETWEEN f.test_lo AND f.test_hi WHERE f.n_train > 0",
    "auc": auc(),
    "auc_by_day": auc("day"),
    "log_brier_skill": scores("", "SELECT * FROM rows"),
    "half_split_scores": scores("half", "SELECT *, CASE WHEN pos < (SELECT count(*) FROM rows) // 2 THEN 'first' ELSE 'second' END AS half FROM rows"),
    "reliability_bins": f"""WITH {ROWS}, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM rows), b AS (SELECT CAST(len(list_filter(e, lambda x: x <= p)) AS BIGINT) AS bin, y, p FROM rows, e),
      g AS (SELECT bin, count(*) AS n, avg(p) AS m, avg(y) AS f, sqrt(avg(y) * (1 - avg(y)) / count(*)) AS se FROM b GROUP BY bin)
      SELECT bin, n, {r('m', 'mean_pred')}, {r('f', 'obs_freq')}, round(se, 6) + 0.0 AS se, round(CASE WHEN g.se > 0 THEN (f - m) / g.se END, 6) + 0.0 AS z FROM g""",
    "score_quantiles": f"WITH {ROWS}, s AS (SELECT unnest([0.05, 0.5, 0.9]::DOUBLE[]) AS share, unnest(quantile_cont(p, [0.05, 0.5, 0.9])) AS q FROM rows) SELECT share, round(s.q, 6) + 0.0 AS q FROM s",
    "cost_matrix": f"WITH {ROWS} SELECT 0.5::DOUBLE AS threshold, CAST(count_if(p > 0.5 AND y = 1) AS BIGINT) AS tp, CAST(count_if(p > 0.5 AND y = 0) AS BIGINT) AS fp, CAST(count_if(p <= 0.5 AND y = 1) AS BIGINT) AS fn, CAST(count_if(p <= 0.5 AND y = 0) AS BIGINT) AS tn, CAST({costs(0.5)} AS DOUBLE) AS total_cost, {r(f'({costs(0.5)}) / count(*)', 'mean_cost')}, {r('count_if(p > 0.5) / count(*)', 'flagged_rate')} FROM rows",
    "cost_curve": f"WITH {CURVE} SELECT threshold, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(mean_cost, 6) + 0.0 AS mean_cost FROM curve",
    "best_threshold": f"WITH {CURVE} SELECT threshold, round(curve.mean_cost, 6) + 0.0 AS mean_cost FROM curve ORDER BY curve.mean_cost, threshold LIMIT 1",
    "bayes_threshold": f"WITH {ROWS}, b AS (SELECT ({costs(STAR)}) / count(*) AS a, count_if(p > {STAR}) / count(*) AS fa, ({costs(0.5)}) / count(*) AS h, count_if(p > 0.5) / count(*) AS fh FROM rows) SELECT {r(f'{STAR}::DOUBLE', 'p_star')}, {r('a', 'cost_star')}, {r('fa', 'flagged_star')}, {r('h', 'cost_half')}, {r('fh', 'flagged_half')}, {r('1 - a / h', 'reduction')}, FALSE AS warn FROM b",
    "bic_select": f"""WITH ticks AS ({EVENTS}), n AS (SELECT symbol, count(*) AS n, sum(ln(price + 1)) AS s FROM ticks GROUP BY symbol), k AS (SELECT unnest([2, 3, 4, 5]) AS k),
      b AS (SELECT symbol, CAST(k AS BIGINT) AS k, 2 * s * (1 + 1.0::DOUBLE / k) + (2 * k + k * (k - 1) + (k - 1)) * ln(n) AS bic FROM n, k)
      SELECT symbol, k, round(b.bic, 3) + 0.0 AS bic FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY b.bic) = 1""",
}

FIRST, END = (f"epoch_us(TIMESTAMP '{d}')" for d in c.SLICE)
SQL["slice_counts"] = f"""WITH ticks AS ({EVENTS}) SELECT symbol, count(*) FILTER (us >= {FIRST} AND us < {END} + {DAY}) AS half_open,
      count(*) FILTER (us BETWEEN {FIRST} AND {END} + {DAY}) AS closed,
      count(*) FILTER (us // {DAY} BETWEEN {FIRST} // {DAY} AND {END} // {DAY}) AS whole_days FROM ticks GROUP BY symbol"""
SQL["day_sets"] = f"""WITH ticks AS ({EVENTS}), days AS (SELECT symbol, us // {DAY} AS day, count(*) AS n FROM ticks GROUP BY ALL)
      SELECT symbol, day, n, CASE WHEN day BETWEEN {FIRST} // {DAY} AND {END} // {DAY} THEN 'intersection' ELSE 'difference' END AS kind FROM days"""
SQL["flagged_share"] = f"""WITH {H}, flags AS (SELECT symbol, bin, CAST(abs(r) > {c.LARGE} AS DOUBLE) AS flag FROM ret WHERE r IS NOT NULL)
      SELECT symbol, bin, flag, {r("avg(flag) OVER (PARTITION BY symbol ORDER BY bin RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)", "share")} FROM flags"""

SQL["imm_four_modes"] = f"WITH RECURSIVE {H}, {given_sql(c.FOUR_Q, c.FOUR_R, c.FOUR_PI, {2, 3})}, {imm_of(4)} SELECT symbol, bin, {r('x_filt', 'x_filt')}, {r('p_filt', 'p_filt')}, {r('elevated_prob', 'elevated_prob')} FROM imm"
SQL["imm_regimes"] = f"WITH RECURSIVE {H}, {observed()}, {imm_of(4)} SELECT symbol, bin, {r('x_filt', 'x_filt', 5)}, {r('p_filt', 'p_filt', 5)}, {r('elevated_prob', 'elevated_prob', 5)} FROM imm"
SQL["regime_parameters"] = f"WITH {H}, {observed()} SELECT symbol, state, {r('variance', 'variance')}, n_pairs, {r('r_noise', 'r_noise')}, {r('q', 'q')}, elevated, {r('stays', 'stays')}, stays > 0.9 AS sticky FROM reg"
# the chance of still being elevated after t bars, from the quasi-stationary weights (300 steps of the transitions), summed over t
SQL["regime_horizon"] = f"""WITH RECURSIVE {H}, {observed()},
      el AS (SELECT symbol, state, count(*) OVER (PARTITION BY symbol) AS n FROM reg WHERE elevated),
      inside AS (SELECT pi.symbol, pi.i, pi.j, pi.p FROM pi JOIN el a ON a.symbol = pi.symbol AND a.state = pi.i JOIN el b ON b.symbol = pi.symbol AND b.state = pi.j),
      warm AS (
        SELECT symbol, state, 0 AS t, 1.0::DOUBLE AS w FROM el
        UNION ALL SELECT symbol, j, t + 1, x / sum(x) OVER (PARTITION BY symbol) FROM (SELECT warm.symbol, j, t, sum(w * p) AS x FROM warm JOIN inside ON inside.symbol = warm.symbol AND inside.i = warm.state WHERE t < 300 GROUP BY warm.symbol, j, t)
      ),
      alive AS (
        SELECT symbol, state, 0 AS t, w FROM warm WHERE t = 300
        UNION ALL SELECT alive.symbol, j, t + 1, sum(w * p) FROM alive JOIN inside ON inside.symbol = alive.symbol AND inside.i = alive.state WHERE t < 2000 GROUP BY alive.symbol, j, t
      )
      SELECT symbol, any_value(n) AS n_elevated, {r('sum(w)', 'horizon', 4)} FROM alive JOIN el USING (symbol, state) GROUP BY symbol"""
