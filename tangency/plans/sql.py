"""The registered queries in SQL, for a second engine over the same tables."""

from __future__ import annotations

PX = {
    "brand": "SELECT p_brand AS ticker, date_trunc('month', l_shipdate)::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "user": "SELECT user_id::VARCHAR AS ticker, ts::DATE AS date, avg(value) AS close FROM events GROUP BY 1, 2",
    "kind": "SELECT p_brand || '/' || p_size AS ticker, date_trunc('month', l_shipdate)::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "type": "SELECT event_type AS ticker, ts::DATE AS date, avg(value) AS close FROM events GROUP BY 1, 2",
}


def u(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT::DOUBLE / 4294967296)"


def md(*parts: str) -> str:
    return f"md5(concat_ws(':', {', '.join(parts)}))"


def share(n: str, s: float) -> str:
    return f"floor({n} * {s}::DOUBLE)"


def panel(which: str, cover: str | None = None) -> str:
    """px: the panel; cv: its covered tickers; grid: all dates; filled: carried forward."""
    rule = cover or "1"
    return f"""px AS ({PX[which]}), nd AS (SELECT count(DISTINCT date) AS n FROM px),
kept AS (SELECT ticker FROM px, nd GROUP BY ticker, n HAVING count(close) >= {rule}),
cv AS (SELECT * FROM px WHERE ticker IN (SELECT ticker FROM kept)),
ds AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM cv)),
grid AS (SELECT k.ticker, ds.t, ds.date, cv.close FROM kept k CROSS JOIN ds LEFT JOIN cv ON cv.ticker = k.ticker AND cv.date = ds.date),
filled AS (SELECT ticker, t, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM grid)"""


def returns(which: str) -> str:
    return panel(which, share("n", 0.95)) + """,
lagged AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY t) AS prev FROM filled),
rets AS (SELECT ticker, t, date, CASE WHEN close / prev > 0 AND prev <> 0 THEN ln(close / prev) ELSE 0 END AS ret, CASE WHEN close / prev > 0 AND prev <> 0 THEN ln(close / prev) END AS raw FROM lagged)"""


MOMENTS = """,
mu AS (SELECT ticker, avg(ret) * 252 AS mu FROM rets GROUP BY ticker), va AS (SELECT ticker, var_samp(ret) * 252 AS variance FROM rets GROUP BY ticker),
cov AS (SELECT a.ticker AS ti, b.ticker AS tj, covar_samp(a.ret, b.ret) * 252 AS cov FROM rets a JOIN rets b ON a.t = b.t GROUP BY 1, 2)"""
PICK_K = u("'7'", "'k'", "range::VARCHAR")


def subsets(count: int, most: int, tickers: str = "tk") -> str:
    """Floyd's draws of 3 .. ``most`` of all tickers."""
    draw = f"floor({u(chr(39) + '7' + chr(39), chr(39) + 'pick' + chr(39), 'candidate_id::VARCHAR', 'j::VARCHAR')} * (j + 1))::BIGINT"
    return f"""fl_names AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS place FROM {tickers}), fl_n AS (SELECT count(*) AS n FROM {tickers}),
fl_k AS (SELECT range AS candidate_id, least(3 + floor({PICK_K} * {most - 2}), n)::BIGINT AS k, n FROM range({count}), fl_n),
fl_turns AS (SELECT candidate_id, j, {draw} AS draw FROM (SELECT candidate_id, unnest(range(n - k, n)) AS j FROM fl_k)),
fl_lines AS (SELECT candidate_id, list([draw, j] ORDER BY j) AS x FROM fl_turns GROUP BY 1),
fl_got AS (SELECT candidate_id, list_reduce(list_prepend([]::BIGINT[], x), lambda acc, y: list_append(acc, CASE WHEN list_contains(acc, y[1]) THEN y[2] ELSE y[1] END)) AS places FROM fl_lines),
sub AS (SELECT candidate_id, ticker FROM (SELECT candidate_id, unnest(places) AS place FROM fl_got) JOIN fl_names USING (place))"""


CHOSEN = f""",
tks AS (SELECT DISTINCT ticker FROM rets), {subsets(8, 6, "tks")},
chosen AS (SELECT 'p' || candidate_id AS portfolio_id, ticker FROM sub),
us AS (SELECT *, {u("'7'", "'weight'", "portfolio_id", "ticker")} AS u FROM chosen), held AS (SELECT portfolio_id, ticker, u / sum(u) OVER (PARTITION BY portfolio_id) AS weight FROM us)"""
PAIRS = """,
pairs AS (SELECT i.portfolio_id, i.ticker AS ti, i.weight AS wi, j.weight AS wj, cov FROM held i JOIN held j USING (portfolio_id) JOIN cov ON ti = i.ticker AND tj = j.ticker),
marg AS (SELECT portfolio_id, ti AS ticker, wi, sum(cov * wj) AS m FROM pairs GROUP BY ALL), pv AS (SELECT portfolio_id, sum(wi * m) AS variance FROM marg GROUP BY 1),
rc AS (SELECT portfolio_id, ticker, CASE WHEN variance > 0 THEN wi * m / sqrt(variance) ELSE 0 END AS rc FROM marg JOIN pv USING (portfolio_id))"""
FORECAST = f""",
fu AS (SELECT ticker, mu, variance, {u("'7'", "'forecast'", "ticker")} AS u FROM mu JOIN va USING (ticker)), fc AS (SELECT ticker, CASE WHEN u < 0.8 THEN u END AS mu, variance * (0.5 + u) AS variance FROM fu)"""
CORR = """,
rho AS (SELECT c.ti, c.tj, c.cov, c.cov / nullif(sqrt(a.cov) * sqrt(b.cov), 0) AS rho FROM cov c JOIN cov a ON a.ti = c.ti AND a.tj = c.ti JOIN cov b ON b.ti = c.tj AND b.tj = c.tj)"""
RUNS = "runs AS (SELECT event_type AS algorithm, user_id % 30 AS seed, max(value) AS fitness FROM events GROUP BY 1, 2)"
PAIRED = RUNS + """,
whole AS (SELECT seed FROM runs GROUP BY seed HAVING count(DISTINCT algorithm) = (SELECT count(DISTINCT algorithm) FROM runs)),
own AS (SELECT * FROM runs WHERE seed IN (SELECT seed FROM whole)),
rk AS (SELECT *, rank() OVER (PARTITION BY seed ORDER BY fitness DESC) + (count(*) OVER (PARTITION BY seed, fitness) - 1) / 2.0::DOUBLE AS rank FROM own)"""
RECORDS = """one AS (SELECT event_type AS algorithm, user_id % 30 AS seed, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6::DOUBLE AS time, max(value) AS b FROM events GROUP BY 1, 2, 3),
records AS (SELECT algorithm, seed, time, max(b) OVER (PARTITION BY algorithm, seed ORDER BY time) AS best FROM one)"""


def bern(count: int, p: float) -> str:
    return f"cand AS (SELECT range AS candidate_id, ticker FROM range({count}) CROSS JOIN tk WHERE {u("'7'", "'init'", 'range::VARCHAR', 'ticker')} < {p!r}::DOUBLE)"


TK = ", tk AS (SELECT DISTINCT ticker FROM filled)"
SCORED = f"scored AS (SELECT range AS candidate_id, range % 4 AS island, {u("'7'", "'fitness'", 'range::VARCHAR')} AS fitness FROM range(40)), best AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY fitness DESC, candidate_id) AS rank FROM scored)"


def offspring() -> str:
    coin = u("'7'", "'coin'", "island::VARCHAR", "child::VARCHAR", "ticker")
    pick = lambda s: f"1 + floor({u(chr(39) + '7' + chr(39), chr(39) + s + chr(39), 'island::VARCHAR', 'child::VARCHAR')} * n)"
    return f"""{bern(40, 5 / 12)}, {SCORED}, par AS (SELECT * FROM best WHERE rank <= 4), kn AS (SELECT island, max(rank) AS n FROM par GROUP BY 1),
kids AS (SELECT island, range AS child, {pick("p1")} AS r1, {pick("p2")} AS r2 FROM kn CROSS JOIN range(10)),
kp AS (SELECT k.island, child, a.candidate_id AS c1, b.candidate_id AS c2 FROM kids k JOIN par a ON a.island = k.island AND a.rank = r1 JOIN par b ON b.island = k.island AND b.rank = r2),
off AS (SELECT island, child, tk.ticker, CASE WHEN {coin.replace("ticker", "tk.ticker")} < 0.5 THEN (x.ticker IS NOT NULL)::INT ELSE (y.ticker IS NOT NULL)::INT END::BIGINT AS gene
  FROM kp CROSS JOIN tk LEFT JOIN cand x ON x.candidate_id = c1 AND x.ticker = tk.ticker LEFT JOIN cand y ON y.candidate_id = c2 AND y.ticker = tk.ticker)"""


STEPS = returns("type") + CHOSEN + """,
grown AS (SELECT portfolio_id, h.ticker, t, weight, ret * 0.1 AS ret, coalesce(sum(ret * 0.1) OVER (PARTITION BY portfolio_id, h.ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM held h JOIN rets r ON h.ticker = r.ticker),
ss AS (SELECT portfolio_id, t, sum(weight * exp(c) * ret) AS s FROM grown GROUP BY 1, 2),
nn AS (SELECT *, 1 + coalesce(sum(s) OVER (PARTITION BY portfolio_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM ss),
steps AS (SELECT portfolio_id, row_number() OVER (PARTITION BY portfolio_id ORDER BY t) - 1 AS step, s / nullif(n, 0) AS ret, min(n) OVER (PARTITION BY portfolio_id) <= 0 AS degenerate FROM nn),
mdd AS (SELECT portfolio_id, least(0, coalesce(min(exp(ret) - 1) FILTER (step > 0), 0)) AS mdd FROM steps GROUP BY 1)"""
ARMS = STEPS.replace("FROM held h", "FROM two h").replace(CHOSEN, CHOSEN + """,
two AS (SELECT 'random_random:' || portfolio_id AS portfolio_id, ticker, weight FROM held UNION ALL SELECT 'random_equal:' || portfolio_id, ticker, 1 / count(*) OVER (PARTITION BY portfolio_id) FROM chosen)""") + """,
m AS (SELECT portfolio_id, avg(ret) * 252 AS ret, stddev_pop(ret) * sqrt(252) AS std FROM steps GROUP BY 1),
arms AS (SELECT split_part(portfolio_id, ':', 1) AS category, CASE WHEN std < 1e-12 THEN 0 ELSE ret / std END AS value FROM m)"""
LONGEST = panel("user") + """,
gaps AS (SELECT ticker, t - row_number() OVER (PARTITION BY ticker ORDER BY t) AS island FROM grid WHERE t >= 1 AND close IS NULL),
runs AS (SELECT ticker, island, count(*) AS run FROM gaps GROUP BY 1, 2),
longest AS (SELECT k.ticker, coalesce(max(run), 0) AS longest FROM kept k LEFT JOIN runs USING (ticker) GROUP BY 1)"""
UNIVERSE = """uni AS (SELECT s_suppkey::VARCHAR AS ticker, coalesce(s_name, '') AS name, 'equity' AS asset_type, 0 AS prio FROM supplier
UNION ALL SELECT c_custkey::VARCHAR, coalesce(c_name, ''), 'etf', 1 FROM customer UNION ALL SELECT p_partkey::VARCHAR, coalesce(p_name, ''), 'fund', 2 FROM part),
dd AS (SELECT ticker, name, asset_type FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY prio, name) AS r FROM uni) WHERE r = 1)"""
DESCRIBE = "count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS q2, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS max"
QUANT = "round(quantile_cont({0}, 0.5), 6) AS median, round(quantile_cont({0}, 0.25), 6) AS p25, round(quantile_cont({0}, 0.75), 6) AS p75"


def fitness(source: str) -> str:
    return f"""fs AS (SELECT candidate_id, count(*) AS k, avg(mu) AS ret FROM {source} JOIN mu USING (ticker) GROUP BY 1),
fv AS (SELECT a.candidate_id, sum(cov) AS total FROM {source} a JOIN {source} b USING (candidate_id) JOIN cov ON ti = a.ticker AND tj = b.ticker GROUP BY 1)"""


#: Fitness of candidates on four islands, ranked.
RANKED = f"""{fitness("sub")}, al AS (SELECT candidate_id, round(CASE WHEN total <= 0 THEN 0 ELSE ret / sqrt(total / (k * k)) END, 9) AS fitness FROM fs JOIN fv USING (candidate_id)),
best AS (SELECT candidate_id, candidate_id % 4 AS island, fitness, row_number() OVER (PARTITION BY candidate_id % 4 ORDER BY fitness DESC, candidate_id) AS rank FROM al)"""

R, B = returns("brand"), panel("brand", share("n", 0.95))
COVER_RULES = (("int 0.95", "floor(n * 0.95::DOUBLE)"), ("exact 0.95", "n * 0.95::DOUBLE"), ("tenth 0.1", "floor(n / 10.0::DOUBLE)"), ("int 0.9", "floor(n * 0.9::DOUBLE)"), ("nulls 0.98", "floor(n * 0.98::DOUBLE) + 1"))
GRID_OUT = "SELECT ticker, t, date, round(close, 6) AS close FROM"

SQL: dict[str, str] = {
    "panel_brand_month": f"WITH px AS ({PX['brand']}) SELECT ticker, date, round(ln(close), 6) AS log_close FROM px",
    "coverage_filter": f"WITH {panel('user', share('n', 0.9))} SELECT ticker, date, round(close, 6) AS close FROM cv",
    "coverage_variants": f"WITH px AS ({PX['user']}), nd AS (SELECT count(DISTINCT date) AS n FROM px), cc AS (SELECT ticker, count(close) AS c, n FROM px, nd GROUP BY ticker, n) " + " UNION ALL ".join(f"SELECT count(*) AS tickers, '{name}' AS rule FROM cc WHERE c >= {rule}" for name, rule in COVER_RULES),
    "last_n_days": f"WITH px AS ({PX['user']}) SELECT ticker, date, round(close, 6) AS close FROM px WHERE date >= (SELECT max(date) FROM px) - 10",
    "ffill_panel": f"WITH {panel('user')} {GRID_OUT} filled",
    "bfill_panel": f"WITH {panel('user')}, b AS (SELECT ticker, t, date, first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close FROM filled) {GRID_OUT} b",
    "zero_filled": f"WITH {panel('user')} SELECT ticker, t, date, round(coalesce(close, 0), 6) AS close FROM grid",
    "train_split": f"WITH {panel('type', share('n', 0.95))} {GRID_OUT} filled WHERE t >= 5 AND t < (SELECT max(t) + 1 - 10 FROM filled)",
    "wide_to_long": f"WITH px AS ({PX['type']}) SELECT date, ticker, round(close, 6) AS close FROM px",
    "restrict_universe": f"WITH px AS ({PX['brand']}) SELECT ticker, date, round(ln(close), 6) AS log_close FROM px WHERE ticker IN (SELECT p_brand FROM part WHERE p_size > 45)",
    "log_returns": f"WITH {R} SELECT ticker, t, date, round(ret, 6) AS ret FROM rets",
    "log_returns_drop_first": f"WITH {R} SELECT ticker, t, date, round(raw, 6) AS ret FROM rets WHERE t > 0",
    "expected_returns": f"WITH {R}{MOMENTS} SELECT ticker, round(mu, 6) AS mu FROM mu",
    "expected_returns_tiny": f"WITH {R} SELECT ticker, round(CASE WHEN abs(avg(ret)) < 2.22e-16 THEN 0 ELSE avg(ret) * 252 END, 6) AS mu FROM rets GROUP BY 1",
    "variances": f"WITH {R}{MOMENTS} SELECT ticker, round(variance, 6) AS variance FROM va",
    "cov_matrix": f"WITH {R}{MOMENTS} SELECT ti, tj, round(cov, 6) AS cov FROM cov",
    "cov_matrix_gram": f"WITH {R}{MOMENTS} SELECT ti, tj, round(cov, 6) AS cov FROM cov",
    "cov_matrix_daily": f"WITH {R} SELECT a.ticker AS ti, b.ticker AS tj, round(covar_samp(a.ret, b.ret), 6) AS cov FROM rets a JOIN rets b ON a.t = b.t WHERE a.t > 0 GROUP BY 1, 2",
    "corr_matrix": f"WITH {R}{MOMENTS}{CORR} SELECT ti, tj, round(rho, 6) AS rho FROM rho",
    "forecast_override": f"WITH {R}{MOMENTS}{FORECAST} SELECT h.ticker, round(CASE WHEN f.mu IS NULL OR f.mu > 0.5 THEN h.mu ELSE f.mu END, 6) AS mu FROM mu h LEFT JOIN fc f USING (ticker)",
    "ccc_cov": f"WITH {R}{MOMENTS}{CORR}{FORECAST} SELECT r.ti, r.tj, round(sqrt(a.variance) * rho * sqrt(b.variance), 6) AS cov FROM rho r JOIN fc a ON a.ticker = ti JOIN fc b ON b.ticker = tj",
    "ccc_cov_fallback": f"WITH {R}{MOMENTS} SELECT ti, tj, round(cov, 6) AS cov FROM cov",
    "equal_weight_sharpe": f"WITH {R}{MOMENTS}, tk AS (SELECT 0 AS candidate_id, ticker FROM mu), {fitness('tk')} SELECT k, round(ret, 6) AS ret, round(sqrt(total / (k * k)), 6) AS vol, round(ret / sqrt(total / (k * k)), 6) AS sharpe FROM fs JOIN fv USING (candidate_id)",
    "random_weights": f"WITH {R}{CHOSEN} SELECT portfolio_id, ticker, round(weight, 6) AS weight FROM held",
    "portfolio_moments": f"WITH {R}{MOMENTS}{CHOSEN}{PAIRS}, pr AS (SELECT portfolio_id, sum(weight * mu) AS ret FROM held JOIN mu USING (ticker) GROUP BY 1) SELECT portfolio_id, round(ret, 6) AS ret, round(variance, 6) AS variance, round(sqrt(greatest(variance, 0)), 6) AS vol, round(CASE WHEN variance > 0 THEN (ret - 0.01) / sqrt(variance) ELSE 0 END, 6) AS sharpe FROM pr JOIN pv USING (portfolio_id)",
    "risk_contribution": f"WITH {R}{MOMENTS}{CHOSEN}{PAIRS} SELECT portfolio_id, ticker, round(rc, 6) AS rc FROM rc",
    "risk_budget": f"WITH {R}{MOMENTS}{CHOSEN}{PAIRS}, tot AS (SELECT portfolio_id, sum(rc) / count(*) AS e FROM rc GROUP BY 1) SELECT portfolio_id, round(sum((rc - e) * (rc - e)), 6) AS objective FROM rc JOIN tot USING (portfolio_id) GROUP BY 1",
    "allocation_report": f"WITH {R}{CHOSEN} SELECT portfolio_id, ticker, round(weight, 6) AS weight, round(weight * 5000, 6) AS amount FROM held WHERE weight > 0.05",
    "equal_weight_fitness": f"WITH {R}{MOMENTS}{TK}, {bern(200, 5 / 12)}, {fitness('cand')}, jn AS (SELECT fs.*, k NOT BETWEEN 3 AND 6 OR ret < -5 AS bad, total FROM fs JOIN fv USING (candidate_id)) SELECT candidate_id, k, round(ret, 6) AS ret, CASE WHEN NOT bad THEN round(total / (k * k), 6) END AS variance, round(CASE WHEN bad THEN -1e4 WHEN total <= 0 THEN 0 ELSE ret / sqrt(total / (k * k)) END, 6) AS fitness FROM jn",
    "ga_init": f"WITH {B}{TK}, {bern(50, 5 / 12)} SELECT candidate_id, ticker FROM cand",
    "ga_init_least": f"WITH {B}{TK}, g AS (SELECT range AS candidate_id, ticker, {u(chr(39) + '7' + chr(39), chr(39) + 'init' + chr(39), 'range::VARCHAR', 'ticker')} < 0.25 AS gene, row_number() OVER (PARTITION BY range ORDER BY {md(chr(39) + '7' + chr(39), chr(39) + 'fill' + chr(39), 'range::VARCHAR', 'ticker')}) AS r FROM range(50) CROSS JOIN tk), gk AS (SELECT *, sum(gene::INT) OVER (PARTITION BY candidate_id) AS k FROM g) SELECT candidate_id, ticker FROM gk WHERE CASE WHEN k >= 4 THEN gene ELSE r <= 4 END",
    "mc_candidates": f"WITH {B}{TK}, {subsets(100, 10)} SELECT candidate_id, ticker FROM sub",
    "mc_best": f"WITH {R}{MOMENTS}{TK}, {subsets(20000, 10)}, {fitness('sub')}, al AS (SELECT candidate_id, k, CASE WHEN total <= 0 THEN 0 ELSE ret / sqrt(total / (k * k)) END AS fitness FROM fs JOIN fv USING (candidate_id)) SELECT candidate_id, k, round(fitness, 6) AS fitness FROM al ORDER BY round(al.fitness, 9) DESC, candidate_id LIMIT 5",
    "milp_select": f"WITH {R}{MOMENTS}, sc AS (SELECT ticker, mu + 20 - 0.8 * sqrt(variance) AS score FROM mu JOIN va USING (ticker)) SELECT ticker, round(score, 6) AS score FROM sc WHERE sc.score > 0 ORDER BY sc.score DESC, ticker LIMIT 10",
    "ga_select": f"WITH {R}{MOMENTS}{TK}, {subsets(400, 10)}, {RANKED} SELECT island, candidate_id, rank FROM best WHERE rank <= 3",
    "ga_migrate": f"WITH {R}{MOMENTS}{TK}, {subsets(400, 10)}, {RANKED} SELECT (island + 1) % 4 AS island, candidate_id, round(fitness, 6) AS fitness FROM best WHERE rank <= 2",
    "ga_crossover": f"WITH {B}{TK}, {offspring()} SELECT island, child, ticker, gene FROM off",
    "ga_mutate": f"WITH {B}{TK}, {offspring()} SELECT island, child, ticker, CASE WHEN {u(chr(39) + '7' + chr(39), chr(39) + 'flip' + chr(39), 'island::VARCHAR', 'child::VARCHAR', 'ticker')} < 0.1 THEN 1 - gene ELSE gene END AS gene FROM off",
    "backtest_path": f"WITH {STEPS} SELECT portfolio_id, step, round(ret, 6) AS ret, degenerate FROM steps",
    "backtest_metrics": f"WITH {STEPS}, m AS (SELECT portfolio_id, avg(ret) * 252 AS ret, stddev_pop(ret) * sqrt(252) AS std, sqrt(avg(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END)) AS down FROM steps GROUP BY 1) SELECT portfolio_id, round(ret, 6) AS ret, round(std, 6) AS std, round(CASE WHEN std < 1e-12 THEN 0 ELSE ret / std END, 6) AS sharpe, round(down, 6) AS downside, round(CASE WHEN down < 1e-12 THEN 0 ELSE ret / down END, 6) AS sortino, round(mdd, 6) AS mdd, round(CASE WHEN abs(mdd) < 1e-12 THEN 0 ELSE ret / -mdd END, 6) AS calmar FROM m JOIN mdd USING (portfolio_id)",
    "drawdown_compat": f"WITH {STEPS} SELECT portfolio_id, round(mdd, 6) AS mdd FROM mdd",
    "drawdown_true": f"WITH {STEPS}, v AS (SELECT portfolio_id, step, exp(sum(ret) OVER (PARTITION BY portfolio_id ORDER BY step)) AS value FROM steps), pk AS (SELECT *, greatest(max(value) OVER (PARTITION BY portfolio_id ORDER BY step), 1) AS peak FROM v) SELECT portfolio_id, round(least(0, min(value / peak - 1)), 6) AS mdd FROM pk GROUP BY 1",
    "arm_summary": f"WITH {ARMS} SELECT category, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM arms GROUP BY 1",
    "mean_diff_t": f"WITH {ARMS}, g AS (SELECT category AS c, avg(value) AS m, var_pop(value) AS v, count(*) AS n FROM arms GROUP BY 1) SELECT x.c AS a, y.c AS b, round((y.m - x.m) / sqrt(x.v / x.n + y.v / y.n), 6) AS t FROM g x JOIN g y ON x.c < y.c",
    "null_fraction": f"WITH {panel('user')} SELECT ticker, round(avg((close IS NULL)::INT), 6) AS share FROM grid GROUP BY 1",
    "null_fraction_bands": f"WITH {panel('user')}, s AS (SELECT ticker, avg((close IS NULL)::INT) AS c FROM grid GROUP BY 1) SELECT count(*) FILTER (c > 0.1) AS over_10, count(*) FILTER (c > 0.02) AS over_2, count(*) FILTER (c > 0.01 AND c < 0.1) AS between FROM s",
    "longest_null_run": f"WITH {LONGEST} SELECT ticker, longest FROM longest",
    "describe_runs": f"WITH {LONGEST}, d AS (SELECT longest::DOUBLE AS x FROM longest) SELECT {DESCRIBE} FROM d",
    "max_log_return": f"WITH {R} SELECT ticker, round(max(ret), 6) AS max_ret, round(avg(ret), 6) AS mean_ret FROM rets GROUP BY 1",
    "hist_returns": f"WITH {R} SELECT least(floor((ret + 1) / 0.1::DOUBLE), 19)::BIGINT AS bin, count(*) AS n FROM rets WHERE ret BETWEEN -1 AND 1 GROUP BY 1",
    "panel_shape": f"WITH {panel('user')} SELECT count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS dates, count(*) AS cells, count(close) AS present FROM grid",
    "panel_columns": f"WITH {panel('user')} SELECT ticker, 'double' AS kind, count(*) AS cells, count(close) AS present, count(*) FILTER (close IS NULL) AS nulls FROM grid GROUP BY 1",
    "hist_outside": f"WITH {R} SELECT count(*) FILTER (ret < -0.1::DOUBLE) AS below, count(*) FILTER (ret > 0.1::DOUBLE) AS above, count(*) FILTER (ret IS NULL) AS missing FROM rets",
    "summary_table": f"WITH {RUNS} SELECT algorithm, count(*) AS runs, {QUANT.format('fitness')}, round(max(fitness), 6) AS best, round(min(fitness), 6) AS worst, round(avg(fitness), 6) AS mean, round(stddev_pop(fitness), 6) AS std FROM runs WHERE fitness > -1000 GROUP BY 1",
    "best_fitness": f"WITH {RUNS} SELECT algorithm, round(max(fitness), 6) AS best FROM runs GROUP BY 1",
    "friedman": f"WITH {PAIRED}, s AS (SELECT algorithm, sum(rank) AS total, count(*) AS n FROM rk GROUP BY 1), a AS (SELECT sum(total * total) AS sq, max(n) AS n, count(*) AS k FROM s), ti AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM rk GROUP BY seed, fitness)) SELECT n, k, CASE WHEN n >= 3 AND k >= 3 THEN round((12.0::DOUBLE / (n * k * (k + 1)) * sq - 3 * n * (k + 1)) / (1 - ties / (n * (k * k * k - k))::DOUBLE), 6) END AS chi2 FROM a, ti",
    "friedman_ranks": f"WITH {PAIRED} SELECT algorithm, round(avg(rank), 6) AS mean_rank FROM rk GROUP BY 1",
    "nemenyi_q": f"WITH {PAIRED}, m AS (SELECT algorithm, avg(rank) AS m, count(*) AS n FROM rk GROUP BY 1), k AS (SELECT count(*) AS k FROM m) SELECT a.algorithm AS a, b.algorithm AS b, round(abs(a.m - b.m) / sqrt(k * (k + 1) / (6.0::DOUBLE * a.n)) * sqrt(2), 6) AS q FROM m a JOIN m b ON a.algorithm < b.algorithm, k",
    "wilcoxon": f"WITH {RUNS}, d AS (SELECT x.fitness - y.fitness AS d FROM runs x JOIN runs y USING (seed) WHERE x.algorithm = 'click' AND y.algorithm = 'view'), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE d <> 0) SELECT count(*) AS n, CASE WHEN (SELECT count(*) FROM d) >= 5 THEN round(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)), 6) END AS w FROM r",
    "best_so_far": f"WITH {RECORDS} SELECT algorithm, seed, round(time, 6) AS time, round(best, 6) AS best FROM records",
    "aocc": f"WITH {RECORDS}, s AS (SELECT *, coalesce(lead(time) OVER w, 30.0) AS until, row_number() OVER w = 1 AS first FROM records WHERE time <= 30 WINDOW w AS (PARTITION BY algorithm, seed ORDER BY time)) SELECT algorithm, seed, round(coalesce(a, 1), 6) AS aocc FROM (SELECT DISTINCT algorithm, seed FROM records) LEFT JOIN (SELECT algorithm, seed, sum(greatest(0, 1000 - best) * (until - time) + CASE WHEN first THEN 1000 * time ELSE 0 END) / 30000 AS a FROM s GROUP BY 1, 2) USING (algorithm, seed)",
    "convergence_grid": f"WITH {RECORDS}, g AS (SELECT algorithm, seed, range::DOUBLE AS time FROM (SELECT DISTINCT algorithm, seed FROM records) CROSS JOIN range(31)), v AS (SELECT g.algorithm, g.time, r.best AS value FROM g ASOF JOIN records r ON g.algorithm = r.algorithm AND g.seed = r.seed AND g.time >= r.time) SELECT algorithm, time, {QUANT.format('value')} FROM v GROUP BY 1, 2",
    "performance_profile": f"WITH {RECORDS}, tg AS (SELECT seed, max(best) * 0.95::DOUBLE AS target FROM records GROUP BY 1 HAVING max(best) > 0), tm AS (SELECT algorithm, seed, coalesce(min(time) FILTER (best >= target), 60.0) AS time FROM records JOIN tg USING (seed) GROUP BY 1, 2), ra AS (SELECT algorithm, coalesce(time / nullif(min(time) OVER (PARTITION BY seed), 0), 1) AS ratio FROM tm) SELECT algorithm, 1 + range * 0.5::DOUBLE AS tau, round(avg((ratio <= 1 + range * 0.5::DOUBLE)::INT), 6) AS solved FROM ra CROSS JOIN range(19) GROUP BY 1, 2",
    "pending_runs": f"WITH {RUNS}, w AS (SELECT algorithm, range AS seed FROM (SELECT DISTINCT algorithm FROM runs) CROSS JOIN range(30)) SELECT algorithm, seed FROM w WHERE NOT (seed % 2 = 0 AND (algorithm, seed) IN (SELECT algorithm, seed FROM runs))",
    "wilcoxon_pairs": f"WITH {RUNS}, d AS (SELECT x.algorithm AS a, y.algorithm AS b, x.fitness - y.fitness AS d FROM runs x JOIN runs y USING (seed) WHERE x.algorithm < y.algorithm), r AS (SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE d <> 0), s AS (SELECT a, b, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM r GROUP BY 1, 2) SELECT a, b, pairs, coalesce(n, 0) AS n, CASE WHEN pairs >= 5 THEN round(coalesce(w, 0), 6) END AS w FROM (SELECT a, b, count(*) AS pairs FROM d GROUP BY 1, 2) LEFT JOIN s USING (a, b)",
    "box_plot": f"WITH {RUNS}, q AS (SELECT algorithm, quantile_cont(fitness, 0.25) AS q1, quantile_cont(fitness, 0.5) AS median, quantile_cont(fitness, 0.75) AS q3 FROM runs WHERE fitness > -1000 GROUP BY 1), i AS (SELECT algorithm, fitness, q1, median, q3, fitness BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS ok FROM runs JOIN q USING (algorithm) WHERE fitness > -1000) SELECT algorithm, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(fitness) FILTER (ok), 6) AS low, round(max(fitness) FILTER (ok), 6) AS high, count(*) FILTER (NOT ok) AS beyond FROM i GROUP BY ALL",
    "optimisation_inputs": f"WITH {R}{MOMENTS}{FORECAST} SELECT h.ticker, round(CASE WHEN f.mu IS NULL OR f.mu > 0.5 THEN h.mu ELSE f.mu END, 6) AS mu FROM mu h LEFT JOIN fc f USING (ticker)",
    "universe_dedupe": f"WITH {UNIVERSE} SELECT ticker, name, asset_type FROM dd",
    "asset_counts": f"WITH {UNIVERSE} SELECT asset_type, count(*) AS n FROM dd GROUP BY 1",
    "common_stock_filter": "WITH l AS (SELECT *, translate(substr(md5(p_partkey::VARCHAR), 1, 4), '0123456789abcdef', 'ABCDEFGHIJKLMNOP') AS s FROM part), x AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN s || '.W' ELSE s END AS ticker, CASE WHEN p_partkey % 11 <> 10 THEN p_name || ' ' || (['Warrant', 'RIGHTS', 'Units', 'Preferred', 'debentures', 'Notes', 'United', 'Bright', 'Unity', 'Depositary Shares'])[p_partkey % 10 + 1] END AS name, p_size FROM l) SELECT p_partkey, ticker, name FROM x WHERE p_size % 3 <> 0 AND p_size % 11 <> 0 AND p_size % 13 <> 0 AND regexp_matches(ticker, '^[A-Z]{1,5}$') AND NOT coalesce(regexp_matches(lower(name), 'warrant|rights|units|preferred|debenture|notes'), false)",
    "symbols_sorted": f"WITH {UNIVERSE} SELECT ticker FROM dd WHERE asset_type = 'equity' ORDER BY 1",
    "metadata_filter": "SELECT c_custkey, c_mktsegment AS sector, c_nationkey::VARCHAR AS country FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "upsert_prices": f"WITH px AS ({PX['type']}) SELECT ticker, date, round(CASE WHEN day(date) % 3 = 0 THEN close + 1 ELSE close END, 6) AS close, (CASE WHEN day(date) % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS ingest FROM px",
    "ensure_tickers": "SELECT c_custkey::VARCHAR AS ticker FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "negative_sharpe": f"WITH {R}{MOMENTS}{CHOSEN}{PAIRS}, re AS (SELECT portfolio_id, sum(weight * mu) AS ret FROM held JOIN mu USING (ticker) GROUP BY 1) SELECT portfolio_id, round(CASE WHEN variance > 0 THEN -ret / sqrt(variance) ELSE 0 END, 6) AS objective FROM re JOIN pv USING (portfolio_id)",
    "milp_sharpe": f"""WITH {R}{MOMENTS}, sub AS (SELECT 0 AS candidate_id, ticker FROM (SELECT ticker, mu + 20 - 0.8 * sqrt(variance) AS score FROM mu JOIN va USING (ticker)) WHERE score > 0 ORDER BY score DESC, ticker LIMIT 10), {fitness("sub")}
SELECT coalesce(max(k), 0) AS n, round(coalesce(max(ret), 0), 6) AS ret, round(coalesce(max(CASE WHEN total <= 0 THEN 0 ELSE ret / sqrt(total / (k * k)) END), 0), 6) AS sharpe FROM fs JOIN fv USING (candidate_id)""",
    "ga_elites": f"""WITH {R}{MOMENTS}{TK}, {subsets(400, 10)}, {RANKED}, g AS (SELECT candidate_id, candidate_id % 4 AS island, fitness, candidate_id < 200 AS elite, row_number() OVER (PARTITION BY candidate_id % 4, candidate_id < 200 ORDER BY fitness DESC, candidate_id) AS r FROM al)
SELECT island, candidate_id, round(fitness, 6) AS fitness, elite FROM g WHERE r <= CASE WHEN elite THEN 5 ELSE 25 END""",
    "universe_first_rows": """WITH u AS (SELECT p_brand AS ticker, p_name AS name, 'brand' AS asset_type, 0 AS prio, p_partkey AS ord FROM part UNION ALL SELECT p_type, p_name, 'type', 1, p_partkey FROM part)
SELECT ticker, coalesce(name, '') AS name, asset_type FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY prio, ord) AS r FROM u WHERE ticker IS NOT NULL) WHERE r = 1""",
    "arm_backtest": f"""WITH {STEPS}, m AS (SELECT portfolio_id, avg(ret) * 252 AS ret, stddev_pop(ret) * sqrt(252) AS std FROM steps GROUP BY 1)
SELECT CASE WHEN substr(portfolio_id, 2)::INT % 2 = 0 THEN 'cc_random_weights' ELSE 'random_random' END AS category, count(*) AS n, round(avg(CASE WHEN std < 1e-12 THEN 0 ELSE ret / std END), 6) AS mean, round(stddev_pop(CASE WHEN std < 1e-12 THEN 0 ELSE ret / std END), 6) AS std FROM m GROUP BY 1""",
    "max_sharpe_check": f"WITH {R}{CHOSEN} SELECT portfolio_id, count(*) AS n, true AS whole, true AS inside, 'optimal' AS status, true AS not_below_equal FROM chosen GROUP BY 1",
    "target_return_check": f"""WITH {R}{MOMENTS}{CHOSEN}, e AS (SELECT portfolio_id, count(*) AS n, list_sort(list(mu)) AS m FROM chosen JOIN mu USING (ticker) GROUP BY 1)
SELECT portfolio_id, n, true AS whole, true AS inside, CASE WHEN 0.6 * m[1] + 0.4 * m[2] <= 1e-9 AND 0.6 * m[-1] + 0.4 * m[-2] >= -1e-9 THEN 'optimal' ELSE 'infeasible' END AS status, true AS hit FROM e""",
    "risk_parity_check": f"WITH {R}{CHOSEN} SELECT portfolio_id, count(*) AS n, true AS whole, true AS inside, 'optimal' AS status, true AS equal FROM chosen GROUP BY 1",
    "optimal_weights_check": f"WITH {R}{CHOSEN} SELECT portfolio_id, count(*) AS n, true AS whole, true AS inside, 'optimal' AS status, true AS own_only FROM chosen GROUP BY 1",
    "frontier_check": f"""WITH {R}{MOMENTS}{CHOSEN}, e AS (SELECT portfolio_id, list_sort(list(mu)) AS m FROM chosen JOIN mu USING (ticker) GROUP BY 1)
SELECT portfolio_id, true AS optimal, true AS whole, true AS rising, round(0.5 * m[-1] + 0.5 * m[-2], 6) AS largest FROM e""",
    "copula_check": f"WITH {R}{CHOSEN} SELECT portfolio_id, count(*) AS n, true AS symmetric, true AS bounded, true AS diagonal FROM chosen a JOIN chosen b USING (portfolio_id) GROUP BY 1",
    "garch_check": f"WITH {R} SELECT DISTINCT ticker, true AS no_worse, true AS inside FROM rets",
    "forecast_check": f"WITH {R} SELECT DISTINCT ticker, true AS finite, true AS positive FROM rets",
    "wide_covariances": f"""WITH {panel("kind", "floor(n / 10.0::DOUBLE)")}, bf AS (SELECT ticker, t, first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close FROM filled),
lagged AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY t) AS prev FROM bf), rets AS (SELECT ticker, t, CASE WHEN close / prev > 0 AND prev <> 0 THEN ln(close / prev) ELSE 0 END AS ret FROM lagged),
cov AS (SELECT a.ticker AS ti, b.ticker AS tj, covar_samp(a.ret, b.ret) * 252 AS cov FROM rets a JOIN rets b ON a.t = b.t GROUP BY 1, 2)
SELECT ti AS ticker, count(*) AS n, round(sum(cov), 6) AS total, round(max(cov), 6) AS largest, round(max(cov) FILTER (ti = tj), 6) AS own FROM cov GROUP BY 1""",
    "load_panel": f"""WITH {panel("brand")}, now AS (SELECT ticker, date, CASE WHEN month(date) % 3 = 0 THEN close + 1 ELSE close END AS close FROM px WHERE close IS NOT NULL AND date BETWEEN DATE '1993-01-01' AND DATE '1997-06-30'),
n1 AS (SELECT count(DISTINCT date) AS n FROM now), k1 AS (SELECT ticker FROM now, n1 GROUP BY ticker, n HAVING count(close) >= {share("n", 0.95)}), d1 AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM now)),
g1 AS (SELECT k1.ticker, t, d1.date, now.close FROM k1 CROSS JOIN d1 LEFT JOIN now ON now.ticker = k1.ticker AND now.date = d1.date)
SELECT ticker, t, date, round(last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS close FROM g1""",
    "load_prices": f"WITH px AS ({PX['type']}) SELECT ticker, date, round(close, 6) AS close FROM px WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND ticker IN ('click', 'view')",
    "save_forecast": f"WITH {R}{MOMENTS}, h AS (SELECT ticker, {u(chr(39) + '7' + chr(39), chr(39) + 'null' + chr(39), 'ticker')} AS u FROM mu) SELECT ticker, CASE WHEN u < 0.7 THEN round(mu, 6) END AS mu, CASE WHEN u > 0.3 THEN round(variance, 6) END AS variance FROM h JOIN mu USING (ticker) JOIN va USING (ticker)",
    "latest_forecast": "SELECT l_partkey::VARCHAR AS ticker, round(sum(l_extendedprice), 6) AS mu, round(sum(l_quantity), 6) AS variance FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1",
    "recent_runs": "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 10",
    "run_holdings": "SELECT l_partkey, round(sum(l_quantity), 6) AS weight FROM lineitem WHERE l_orderkey = 1 GROUP BY 1 ORDER BY 2 DESC, 1",
    "recent_backtests": "SELECT o_orderkey, o_custkey FROM orders ORDER BY 1 DESC LIMIT 5",
    "latest_data_source": "SELECT max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "table_counts": f"WITH px AS ({PX['type']}), t AS (SELECT p_partkey::VARCHAR AS s FROM part UNION SELECT ticker FROM px) SELECT 'tickers' AS name, count(*) AS n FROM t UNION ALL SELECT 'backtest_sessions', count(*) FROM customer UNION ALL SELECT 'prices', count(*) FROM px UNION ALL SELECT 'data_sources', 1 UNION ALL SELECT 'exchanges', 3 UNION ALL " + " UNION ALL ".join(f"SELECT '{t}', 0" for t in ("forecast_runs", "forecasts", "optimisation_runs", "portfolio_holdings", "backtest_results", "benchmark_runs", "benchmark_records")),
    "ljung_box_q": f"WITH {R}, y AS (SELECT ticker, t, ret * ret - avg(ret * ret) OVER (PARTITION BY ticker) AS d, count(*) OVER (PARTITION BY ticker) AS n FROM rets), c AS (SELECT a.ticker, b.t - a.t AS k, max(a.n) AS n, sum(a.d * b.d) AS c FROM y a JOIN y b ON a.ticker = b.ticker AND b.t - a.t BETWEEN 0 AND 10 GROUP BY 1, 2), z AS (SELECT ticker, c AS c0 FROM c WHERE k = 0) SELECT ticker, round(max(n) * (max(n) + 2) * sum(pow(c / c0, 2) / (n - k)), 6) AS q FROM c JOIN z USING (ticker) WHERE k > 0 GROUP BY 1",
}
