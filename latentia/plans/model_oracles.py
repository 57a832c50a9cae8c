"""DuckDB SQL of fitted models: Newton steps and convex hulls as recursive queries, stated from the definitions."""

from __future__ import annotations

from latentia.plans import catalogue as c
from latentia.plans import forecasts as f
from latentia.plans.oracles import BY, LABELLED, ROLLING, ROWS, SQL, STAR, H, imm_of, observed, r

STEPS = 14


def newton(k: int, penalty: float, train: str = "train", fit: str = "fit") -> str:
    """CTE fit (fold, it, w0..): Newton steps of logistic regression on CTE train (fold, y, z1..); w0 is not penalised.

    The step solves the normal equations by elimination, one column at a time, then backwards.
    """
    n = range(k)
    z = lambda i: "1.0" if i == 0 else f"z{i}"
    ridge = lambda i: 0.0 if i == 0 else penalty
    p = "1 / (1 + exp(-greatest(least(" + " + ".join(f"w{i} * {z(i)}" for i in n) + ", 40), -40)))"
    h = ", ".join(f"sum(p * (1 - p) * {z(i)} * {z(j)}) + {(ridge(i) + 1e-12) if i == j else 0.0} AS h{i}{j}" for i in n for j in n)
    g = ", ".join(f"sum((p - y) * {z(i)}) + {ridge(i)} * any_value(w{i}) AS h{i}{k}" for i in n)
    level = f"SELECT fold, it, {', '.join(f'any_value(w{i}) AS w{i}' for i in n)}, {h}, {g} FROM (SELECT {fit}.fold, it, y, {', '.join([f'w{i}' for i in n] + [f'z{i}' for i in n if i])}, {p} AS p FROM {fit} JOIN {train} ON {train}.fold = {fit}.fold WHERE it < {STEPS}) GROUP BY fold, it"
    for a in range(k - 1):
        down = ", ".join(f"h{i}{j} - h{i}{a} / h{a}{a} * h{a}{j} AS h{i}{j}" if i > a and j > a else f"h{i}{j}" for i in n for j in range(k + 1))
        level = f"SELECT fold, it, {', '.join(f'w{i}' for i in n)}, {down} FROM ({level})"
    for i in reversed(n):
        rest = " - ".join([f"h{i}{k}"] + [f"h{i}{j} * s{j}" for j in range(i + 1, k)])
        level = f"SELECT *, ({rest}) / h{i}{i} AS s{i} FROM ({level})"
    step = ", ".join(f"w{i} - s{i}" for i in n)
    return f"{fit} AS (SELECT DISTINCT fold, 0 AS it, {', '.join(f'0.0::DOUBLE AS w{i}' for i in n)} FROM {train} UNION ALL SELECT fold, it + 1, {step} FROM ({level}))"


def hull(points: str) -> str:
    """CTEs pt, walk, blocks (fold, lo, hi, y): isotonic regression of points (fold, x, s, w) as the lower hull of its cumulative sums.

    From each corner the next is the point of least slope, the farthest of equal ones.
    """
    return f"""pt AS (SELECT fold, x, row_number() OVER (PARTITION BY fold ORDER BY x) AS i, sum(s) OVER (PARTITION BY fold ORDER BY x) AS cs, sum(w) OVER (PARTITION BY fold ORDER BY x) AS cw FROM ({points})),
      corner AS (SELECT fold, i, cs, cw FROM pt UNION ALL SELECT DISTINCT fold, 0, 0.0, 0 FROM pt),
      walk AS (
        SELECT DISTINCT fold, CAST(-1 AS BIGINT) AS came, CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS y FROM pt
        UNION ALL SELECT fold, i, -best.j, best.slope FROM (
          SELECT walk.fold, walk.i, min(struct_pack(slope := (p.cs - q.cs)::DOUBLE / (p.cw - q.cw)::DOUBLE, j := -p.i)) AS best
          FROM walk JOIN corner q ON q.fold = walk.fold AND q.i = walk.i JOIN pt p ON p.fold = walk.fold AND p.i > walk.i GROUP BY walk.fold, walk.i)
      ),
      blocks AS (SELECT walk.fold, a.x AS lo, b.x AS hi, walk.y FROM walk JOIN pt a ON a.fold = walk.fold AND a.i = walk.came + 1 JOIN pt b ON b.fold = walk.fold AND b.i = walk.i WHERE walk.y IS NOT NULL)"""


def calibrated(rows: str, more: str = "", digits: int = 6) -> str:
    """Rows (fold, pos, y, p) with the value of the blocks of their fold at p."""
    value = "(CASE WHEN a.lo IS NULL THEN b.y WHEN b.lo IS NULL THEN a.y WHEN a.lo = b.lo THEN a.y ELSE a.y + (b.y - a.y) * (t.p - a.hi) / (b.lo - a.hi) END)"
    return f"""SELECT t.pos, t.y AS y_true, {r('t.p', 'y_pred_raw', digits)}, {r(value + ' + 1e-11', 'y_pred_calibrated', digits)}{more}
      FROM ({rows}) t ASOF LEFT JOIN blocks a ON a.fold = t.fold AND t.p >= a.lo ASOF LEFT JOIN blocks b ON b.fold = t.fold AND t.p <= b.hi WHERE t.fold IN (SELECT fold FROM blocks)"""


def static(rows: str, prefix: str = "", digits: int = 6) -> str:
    """Fit on the earlier half of the rows CTE, predict the later."""
    first = "SELECT 0 AS fold, p AS x, sum(y) AS s, count(*) AS w FROM rows WHERE pos < (SELECT count(*) FROM rows) // 2 GROUP BY p"
    later = "SELECT 0 AS fold, pos, y, p FROM rows WHERE pos >= (SELECT count(*) FROM rows) // 2"
    return f"WITH RECURSIVE {prefix}{rows}, {hull(first)} {calibrated(later, digits=digits)}"


def by_regime(rows: str, column: str, digits: int = 6) -> str:
    """The same within the rows at or below the median of a column and above it, numbered anew in each."""
    parts = f"""part AS (SELECT CASE WHEN {column} <= (SELECT quantile_cont({column}, 0.5) FROM rows) THEN 'calm' ELSE 'elevated' END AS regime, pos, y, p FROM rows),
      own AS (SELECT regime AS fold, row_number() OVER (PARTITION BY regime ORDER BY pos) - 1 AS pos, count(*) OVER (PARTITION BY regime) AS n, y, p FROM part)"""
    first = "SELECT fold, p AS x, sum(y) AS s, count(*) AS w FROM own WHERE pos < n // 2 GROUP BY fold, p"
    return f"WITH RECURSIVE {rows}, {parts}, {hull(first)} {calibrated('SELECT fold, pos, y, p FROM own WHERE pos >= n // 2', ', t.fold AS regime', digits)}"


NUMBERED = "numbered AS (SELECT rows.*, dense_rank() OVER (ORDER BY day) - 1 AS ordinal FROM rows)"


def walk_forward(rows: str, window: int | None, digits: int = 6) -> str:
    """Each day from the fourth on, by its past."""
    near = f" AND q.ordinal >= d.ordinal - {window}" if window else ""
    points = f"""SELECT * FROM (
        SELECT d.ordinal AS fold, q.p AS x, sum(q.y) AS s, count(*) AS w, sum(sum(q.y)) OVER (PARTITION BY d.ordinal) AS ones, sum(count(*)) OVER (PARTITION BY d.ordinal) AS n
        FROM (SELECT DISTINCT ordinal FROM numbered WHERE ordinal >= 3) d JOIN numbered q ON q.ordinal < d.ordinal{near} GROUP BY d.ordinal, q.p) WHERE ones > 0 AND ones < n"""
    return f"WITH RECURSIVE {rows}, {NUMBERED}, {hull(points)} {calibrated('SELECT ordinal AS fold, pos, y, p FROM numbered', digits=digits)}"


def platt(rows: str, digits: int = 6) -> str:
    """Each day from the fourth on, by logistic regression on the logits of the five days before it."""
    clipped = "greatest(least(p, 1 - 1e-12), 1e-12)"
    return f"""WITH RECURSIVE {rows}, {NUMBERED}, l AS (SELECT *, ln({clipped} / (1 - {clipped})) AS z FROM numbered),
      past AS (SELECT d.ordinal AS fold, q.y, q.z AS z1 FROM (SELECT DISTINCT ordinal FROM l WHERE ordinal >= 3) d JOIN l q ON q.ordinal < d.ordinal AND q.ordinal >= d.ordinal - 5),
      learned AS (SELECT * FROM past WHERE fold IN (SELECT fold FROM past GROUP BY fold HAVING min(y) < max(y))), {newton(2, 1.0, "learned", "scaled")}
      SELECT l.pos, l.y AS y_true, {r('l.p', 'y_pred_raw', digits)}, {r('1 / (1 + exp(-(w0 + w1 * l.z))) + 1e-11', 'y_pred_calibrated', digits)} FROM l JOIN scaled ON scaled.fold = l.ordinal WHERE it = {STEPS}"""


def logistic(data: str) -> str:
    """CTEs oof (pos, fold, y, p): walk-forward logistic regression on CTE data (pos, day, y, x1, x2, x3)."""
    x = (1, 2, 3)
    return f"""days AS (SELECT row_number() OVER (ORDER BY day) - 1 AS fold, min(pos) AS lo, max(pos) AS hi FROM data GROUP BY day),
      zones AS (SELECT fold, hi + 1 AS first, hi + {c.EMBARGO} AS stop FROM days WHERE fold >= 1),
      members AS (SELECT d.fold, t.y, {", ".join(f"t.x{i}" for i in x)} FROM days d JOIN data t ON t.pos < d.lo - {c.PURGE} WHERE d.fold >= 1 AND NOT EXISTS (SELECT 1 FROM zones z WHERE z.fold < d.fold AND t.pos BETWEEN z.first AND z.stop)),
      usable AS (SELECT fold, {", ".join(f"avg(x{i}) AS m{i}, CASE WHEN stddev_pop(x{i}) > 0 THEN stddev_pop(x{i}) ELSE 1 END AS s{i}" for i in x)} FROM members GROUP BY fold HAVING min(y) < max(y)),
      train AS (SELECT fold, y, {", ".join(f"(x{i} - m{i}) / s{i} AS z{i}" for i in x)} FROM members JOIN usable USING (fold)), {newton(4, 1.0)},
      oof AS (SELECT t.pos, d.fold, t.y, 1 / (1 + exp(-(w0 + {" + ".join(f"w{i} * (x{i} - m{i}) / s{i}" for i in x)}))) AS p
        FROM data t JOIN days d ON t.pos BETWEEN d.lo AND d.hi JOIN usable u ON u.fold = d.fold JOIN fit ON fit.fold = d.fold AND it = {STEPS})"""


#: pos, day, y, x1, x2, x3 (and elevated_prob) from a CTE labelled (symbol, bin, elevated_prob, rolling_vol, real_label).
DATA = f"""whole AS (SELECT *, lag(elevated_prob) OVER ({BY} bin) AS before FROM labelled),
      data AS (SELECT row_number() OVER (ORDER BY bin, symbol) - 1 AS pos, bin // 24 AS day, real_label AS y, elevated_prob AS x1, before AS x2, rolling_vol AS x3 FROM whole WHERE real_label IS NOT NULL AND before IS NOT NULL AND rolling_vol IS NOT NULL)"""
AHEAD = f"OVER ({BY} bin ROWS BETWEEN 1 FOLLOWING AND {f.AHEAD} FOLLOWING)"
FILTERED = f"""{H}, {observed()}, {imm_of(4)}, vol AS (SELECT symbol, bin, stddev_samp(r) OVER ({ROLLING}) AS rolling_vol FROM ret WHERE r IS NOT NULL),
      labelled AS (SELECT *, CAST(forward_mean > 0.5 AS DOUBLE) AS real_label FROM (
        SELECT vol.symbol, vol.bin, elevated_prob, rolling_vol, CASE WHEN count(elevated_prob) {AHEAD.replace('symbol', 'vol.symbol').replace(' bin', ' vol.bin')} = {f.AHEAD} THEN avg(elevated_prob) {AHEAD.replace('symbol', 'vol.symbol').replace(' bin', ' vol.bin')} END AS forward_mean
        FROM vol JOIN imm ON imm.symbol = vol.symbol AND imm.bin = vol.bin))"""
OOF = f"""{FILTERED}, {DATA}, {logistic('data')},
      rows AS (SELECT row_number() OVER (ORDER BY oof.pos) - 1 AS pos, fold, day, oof.y AS y, round(p, {f.DIGITS}) AS p, x1 AS elevated_prob FROM oof JOIN data ON data.pos = oof.pos)"""

PLAIN = f"{LABELLED}, paired AS (SELECT scored.*, real_label FROM scored JOIN labelled USING (symbol, bin)), {DATA.replace('FROM labelled', 'FROM paired')}"
SQL["lr_oof"] = f"WITH RECURSIVE {PLAIN}, {logistic('data')} SELECT pos, fold, y AS y_true, {r('p', 'y_pred')} FROM oof"


def leakage(select: str) -> str:
    """CTE aucs (label, scheme, auc_real, auc_dummy): model and class prior under naive and purged folds, real label 0 and each shifted one."""
    x = (1, 2, 3)
    auc = lambda p: f"(sum(CASE WHEN y = 1 THEN {p}_rank END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))"
    rank = lambda p: f"rank() OVER (PARTITION BY scheme, label ORDER BY {p}) + (count(*) OVER (PARTITION BY scheme, label, {p}) - 1) / 2.0 AS {p}_rank"
    shifts = ", ".join(f"({i}, {n})" for i, n in enumerate(c.SHIFTS))
    return f"""WITH RECURSIVE {PLAIN}, spot AS (SELECT symbol, bin, real_label, row_number() OVER ({BY} bin) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM paired WHERE real_label IS NOT NULL),
      placed AS (SELECT row_number() OVER (ORDER BY bin, symbol) - 1 AS pos, symbol, bin FROM whole WHERE real_label IS NOT NULL AND before IS NOT NULL AND rolling_vol IS NOT NULL),
      targets AS (
        SELECT pos, 0 AS label, y FROM data
        UNION ALL SELECT placed.pos, s.i + 1, q.real_label FROM placed JOIN spot ON spot.symbol = placed.symbol AND spot.bin = placed.bin, (VALUES {shifts}) s(i, shift) JOIN spot q ON q.symbol = spot.symbol AND q.p = ((spot.p - s.shift) % spot.n + spot.n) % spot.n
      ),
      days AS (SELECT row_number() OVER (ORDER BY day) - 1 AS fold, min(pos) AS lo, max(pos) AS hi FROM data GROUP BY day),
      zones AS (SELECT fold, hi + 1 AS first, hi + {c.EMBARGO} AS stop FROM days WHERE fold >= 1),
      many AS (SELECT count(*) - 1 AS k, (SELECT count(*) FROM data) AS n FROM days),
      bounds AS (SELECT i AS fold, i * n // k AS lo, (i + 1) * n // k - 1 AS hi FROM (SELECT k, n, unnest(range(k)) AS i FROM many)),
      tested AS (SELECT 'purged' AS scheme, fold, pos FROM days JOIN data ON pos BETWEEN lo AND hi WHERE fold >= 1 UNION ALL SELECT 'naive', fold, pos FROM bounds JOIN data ON pos BETWEEN lo AND hi),
      members AS (
        SELECT 'purged' AS scheme, d.fold, t.pos FROM days d JOIN data t ON t.pos < d.lo - {c.PURGE} WHERE d.fold >= 1 AND NOT EXISTS (SELECT 1 FROM zones z WHERE z.fold < d.fold AND t.pos BETWEEN z.first AND z.stop)
        UNION ALL SELECT 'naive', fold, pos FROM bounds JOIN data ON pos < lo OR pos > hi
      ),
      scaling AS (SELECT scheme, fold, {", ".join(f"avg(x{i}) AS m{i}, CASE WHEN stddev_pop(x{i}) > 0 THEN stddev_pop(x{i}) ELSE 1 END AS s{i}" for i in x)} FROM members JOIN data USING (pos) GROUP BY ALL),
      groups AS (SELECT scheme, fold, label, fold * 1000 + label * 2 + CAST(scheme = 'naive' AS INTEGER) AS id, avg(y) AS prior, min(y) < max(y) AS usable FROM members JOIN targets USING (pos) GROUP BY ALL),
      train AS (SELECT id AS fold, targets.y, {", ".join(f"(x{i} - m{i}) / s{i} AS z{i}" for i in x)} FROM members JOIN data USING (pos) JOIN targets USING (pos) JOIN groups USING (scheme, fold, label) JOIN scaling USING (scheme, fold) WHERE usable), {newton(4, 1.0)},
      made AS (SELECT scheme, label, targets.y, round(prior, 9) AS dummy, CASE WHEN usable THEN round(1 / (1 + exp(-(w0 + {" + ".join(f"w{i} * (x{i} - m{i}) / s{i}" for i in x)}))), 9) END AS model
        FROM tested JOIN data USING (pos) JOIN targets USING (pos) JOIN groups USING (scheme, fold, label) JOIN scaling USING (scheme, fold) LEFT JOIN fit ON fit.fold = groups.id AND it = {STEPS}),
      of_real AS (SELECT scheme, label, {auc('model')} AS auc_real FROM (SELECT *, {rank('model')} FROM made WHERE model IS NOT NULL) GROUP BY ALL),
      of_dummy AS (SELECT scheme, label, {auc('dummy')} AS auc_dummy FROM (SELECT *, {rank('dummy')} FROM made) GROUP BY ALL),
      aucs AS (SELECT * FROM of_real JOIN of_dummy USING (scheme, label)) {select}"""


SQL["leakage_real_vs_dummy"] = leakage(f"SELECT CAST(label AS INTEGER) AS label, scheme, {r('auc_real', 'auc_real', 4)}, {r('auc_dummy', 'auc_dummy', 4)} FROM aucs")
SQL["leakage_summary"] = leakage(f"SELECT scheme, count(*) AS n, {r('avg(auc_real - auc_dummy)', 'mean_diff', 4)}, {r('stddev_samp(auc_real - auc_dummy)', 'std_diff', 4)}, count(*) FILTER (auc_real > auc_dummy) AS n_positive FROM aucs WHERE label > 0 GROUP BY scheme")
SQL["isotonic_static"] = static(ROWS)
SQL["isotonic_regime"] = by_regime(f"{ROWS.replace('rows AS', 'plain AS')}, rows AS (SELECT *, (pos * 7919 % 1000) / 1000.0 AS elevated_prob FROM plain)", "elevated_prob")
SQL["isotonic_walkforward"] = walk_forward(ROWS, 5)
SQL["isotonic_expanding"] = walk_forward(ROWS, None)
SQL["platt_walkforward"] = platt(ROWS)

SQL["regime_features"] = f"WITH RECURSIVE {FILTERED} SELECT symbol, bin, {r('elevated_prob', 'elevated_prob', 5)}, {r(f'lag(elevated_prob) OVER ({BY} bin)', 'elevated_prob_lag1', 5)}, {r('rolling_vol', 'rolling_vol', 5)}, {r('forward_mean', 'forward_mean', 5)}, real_label FROM labelled"
SQL["oof_predictions"] = f"WITH RECURSIVE {OOF} SELECT pos, fold, y AS y_true, {r('p', 'y_pred', 5)}, {r('elevated_prob', 'elevated_prob', 5)} FROM rows"
SQL["oof_scores"] = f"""WITH RECURSIVE {OOF}, clipped AS (SELECT *, greatest(least(p, 1 - 1e-12), 1e-12) AS q, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS mid FROM rows),
      s AS (SELECT count(*) AS n, avg(y) AS b, -avg(y * ln(q) + (1 - y) * ln(1 - q)) AS l, avg((p - y) * (p - y)) AS e, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg, sum(CASE WHEN y = 1 THEN mid END) AS m FROM clipped)
      SELECT n, {r('b', 'base_rate', 5)}, {r('l', 'log_score', 5)}, {r('e', 'brier', 5)}, {r('1 - l / -(b * ln(b) + (1 - b) * ln(1 - b))', 'log_skill', 5)}, {r('1 - e / (b * (1 - b))', 'brier_skill', 5)}, n_pos, n_neg, {r('(m - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)', 'auc', 5)} FROM s"""
SQL["oof_reliability"] = f"""WITH RECURSIVE {OOF}, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM rows), b AS (SELECT CAST(len(list_filter(e, lambda x: x <= p)) AS BIGINT) AS bin, y, p FROM rows, e),
      g AS (SELECT bin, count(*) AS n, avg(p) AS m, avg(y) AS f, sqrt(avg(y) * (1 - avg(y)) / count(*)) AS se FROM b GROUP BY bin)
      SELECT bin, n, {r('m', 'mean_pred', 4)}, {r('f', 'obs_freq', 4)}, round(se, 4) + 0.0 AS se, round(CASE WHEN g.se > 0 THEN (f - m) / g.se END, 4) + 0.0 AS z FROM g"""
SQL["oof_isotonic"] = static(OOF, digits=5)
SQL["oof_isotonic_regime"] = by_regime(OOF, "elevated_prob", 5)
SQL["oof_isotonic_expanding"] = walk_forward(OOF, None, 5)
SQL["oof_platt"] = platt(OOF, 5)
COSTS = "count_if(p > {0} AND y = 0) * {1} + count_if(p <= {0} AND y = 1) * {2}"
SQL["oof_costs"] = f"""WITH RECURSIVE {OOF}, b AS (SELECT ({COSTS.format(STAR, c.C_FP, c.C_FN)}) / count(*) AS a, count_if(p > {STAR}) / count(*) AS fa, ({COSTS.format(0.5, c.C_FP, c.C_FN)}) / count(*) AS h, count_if(p > 0.5) / count(*) AS fh FROM rows)
      SELECT {r(f'{STAR}::DOUBLE', 'p_star', 5)}, {r('a', 'cost_star', 5)}, {r('fa', 'flagged_star', 5)}, {r('h', 'cost_half', 5)}, {r('fh', 'flagged_half', 5)}, {r('1 - a / h', 'reduction', 5)}, FALSE AS warn FROM b"""
