"""Every query of the engine by name, and the DuckDB SQL that it equals.

Doubles are rounded in both, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fragments import div, render, roll
from ..operators import backtest, foresight, fusion, interaction, learned, recovery, rules, samples, shapes, signals, studies
from ..operators.features import densify, densify_sql, derive, derive_sql, stages_for
from ..sources import bars, files, simulator
from ..sources.kept import kept
from ..streaming import bars as stream_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 7


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    # adding 0 turns -0 into 0
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def register(name: str, query: Query, sql: str | None = None, doubles: str = "", digits: int = DIGITS) -> None:
    """doubles: the names of double columns, which the SQL rounds."""
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir), digits)
    if sql is not None:
        again = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split())
        ORACLES[name] = f"SELECT * REPLACE ({again}) FROM ({sql})" if again else sql


WALK, BOUNDED, HOURLY = (bars.in_duckdb(x) for x in (bars.WALK, bars.BOUNDED, bars.HOURLY))
_BARS = f"bars AS ({WALK})"
_PRICES = "open high low close volume"

register("bars_weekly", bars.walk, f"SELECT * FROM ({WALK})", f"{_PRICES} quality or30_high or30_low")
register("bars_bounded", bars.bounded, f"SELECT * FROM ({BOUNDED})", _PRICES)
register("bars_hourly", bars.hourly, f"SELECT * FROM ({HOURLY})", _PRICES)


def _derived(columns: str) -> tuple[Query, str]:
    stages, names = stages_for(columns), columns.replace(" ", ", ")
    ctes, last = derive_sql("dense", stages)
    sql = "WITH " + ", ".join([_BARS, f"dense AS ({densify_sql('bars')})", *(render(c, "duckdb") for c in ctes)]) + f" SELECT date, ticker, {names} FROM {last} WHERE present"
    return lambda spark, sf_dir: derive(densify(bars.walk(spark, sf_dir)), stages).where("present").select("date", "ticker", *columns.split()), sql


for _name, _columns in {
    "features_base": "ret gap rvol atr vol20 hi52 lo52",
    "features_context": "gap rvol prox mom121 vol20",
    "features_ranks": "quality_rank mom_rank rvol_rank",
}.items():
    register(_name, *_derived(_columns), doubles=_columns)

_Z = f"CASE WHEN {div('volume - (' + roll('avg', 'volume', 63, 20, before=1) + ')', roll('stddev_samp', 'volume', 63, 20, before=1))} > 2 THEN 1 ELSE 0 END AS flag"
register("catalyst_zflag", lambda spark, sf_dir: bars.walk(spark, sf_dir).selectExpr("date", "ticker", _Z), f"WITH {_BARS} SELECT date, ticker, {_Z} FROM bars")

for _name, _of in {
    "gap_taxonomy": ["gaps"],
    "anchors": ["anchors"],
    "orb": ["orb_30min_up", "orb_30min_dn"],
    "donchian": [f"donchian{n}_{x}" for n in (20, 55) for x in ("up", "dn", "up_hotvol")],
    "vcp": ["vcp_breakout"],
    "high_volume_premium": ["high_volume_premium"],
    "volume_spikes": ["rvol_spike_up", "rvol_spike_dn"],
    "ad_divergence": ["accumulation_divergence", "distribution_divergence"],
    "obv_confirm": ["obv_confirmed_breakout"],
    "ma_cross": [f"ma_cross_{k}_{d}" for k in ("5_20", "20_50", "50_200") for d in ("up", "dn")],
    "tsmom": ["tsmom_12_1_up", "tsmom_12_1_dn"],
    "xs_momentum": ["xs_momentum_winner", "xs_momentum_loser"],
    "bollinger": ["bollinger_breakout_up", "bollinger_revert_long"],
    "keltner_ewm": ["keltner_breakout_up"],
    "quality_decile": ["quality_long", "quality_short"],
    "quality_breakout": ["quality_breakout"],
    "candles_single": ["hammer", "shooting_star", "bull_marubozu", "bear_marubozu"],
    "candles_multi": ["bull_engulf", "bear_engulf", "bull_harami", "bear_harami", "piercing", "dark_cloud", "morning_star", "evening_star", "three_white_soldiers", "three_black_crows"],
    "swing_levels": ["bounce_resistance", "break_resistance", "bounce_support", "break_support"],
    "round_levels": ["round_number_above", "round_number_below"],
    "anchored_vwap": ["avwap_reclaim", "avwap_loss"],
    "ma_levels": [f"ma{n}_{x}" for n in (20, 50, 200) for x in ("bounce", "loss")],
    "tpi": ["tpi_pullback_long", "tpi_rally_short"],
    "cer_quantile": ["cer_expansion_long", "cer_expansion_short"],
    "amo_decay": ["amo_reclaim_long", "amo_stretch_short"],
    "spi": ["spi_dipbuy_long", "spi_rejection_short"],
    "liquidity_vacuum": ["liquidity_vacuum_fade"],
    "gap_echo": ["gap_echo_continuation"],
    "flags": ["bull_flag", "bear_flag"],
}.items():
    _some = rules.rules(*_of)
    register(_name, lambda spark, sf_dir, some=_some: signals.detect(bars.walk(spark, sf_dir), some), signals.detect_sql([_BARS], "bars", _some), "strength")

register("all_signals", lambda spark, sf_dir: signals.detect(bars.walk(spark, sf_dir), rules.rules()), signals.detect_sql([_BARS], "bars", rules.rules()), "strength")
register(
    "gap_interaction",
    lambda spark, sf_dir: interaction.gap_interaction(bars.walk(spark, sf_dir)),
    f"WITH {_BARS} SELECT * FROM ({interaction.gap_sql('duckdb', 'bars')})",
    "p_intraday_cont p_filled_same_day nextday_drift_bps d5_drift_bps",
)
register(
    "breakout_interaction",
    lambda spark, sf_dir: interaction.breakout_interaction(bars.walk(spark, sf_dir)),
    f"WITH {_BARS} SELECT * FROM ({interaction.breakout_sql('duckdb', 'bars')})",
    "nextday_drift_bps d5_drift_bps p_nextday_cont",
)

#: The signals that event-study queries run on: every rule of every family that has rules.
STUDIED = tuple(f for f in rules.FAMILIES if f != "ml")
_STUDIED = rules.rules(*STUDIED)
_SIGNALS = f"signals AS ({signals.detect_sql([], 'bars', _STUDIED).replace('dense', 'grid')})"


def studied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The weekly bars and their signals, both kept: event studies read each several times."""
    panel = kept(bars.walk(spark, sf_dir), "bars")
    return panel, kept(signals.detect(panel, _STUDIED), "signals")


def _study(name: str, ctes: list[str], select: str, doubles: str, spark_ctes: list[str] | None = None, by=None) -> None:
    """by: a function of panel and signals that comes to the same in Spark, where reading a step once is worth it."""
    in_duckdb = render("WITH " + ", ".join([_BARS, _SIGNALS, *(c.format(panel="bars", signals="signals") for c in ctes)]) + " " + select, "duckdb")

    def query(spark, sf_dir):
        if not any("{signals}" in c for c in ctes):
            return backtest.run(kept(bars.walk(spark, sf_dir), "bars"), spark_ctes or ctes, select)
        panel, found = studied(spark, sf_dir)
        return by(panel, found) if by is not None else backtest.run(panel, spark_ctes or ctes, select, found)

    register(name, query, in_duckdb, doubles)


_daily, _forward, _attached = backtest.daily_ctes(), backtest.forward_ctes(), backtest.attached_ctes()
_by_h = lambda *p: " ".join(f"{x}_{h}" for h in backtest.HORIZONS for x in p)
_study("forward_returns", [_daily, _forward], "SELECT date, ticker, cc, oc, " + _by_h("no", "sc").replace(" ", ", ") + " FROM forward WHERE present", "cc oc " + _by_h("no", "sc"))
_study("market_benchmark", [_daily], "SELECT date, mkt_cc, mkt_oc, " + _by_h("mkt_sc", "mkt_no").replace(" ", ", ") + " FROM market", "mkt_cc mkt_oc " + _by_h("mkt_sc", "mkt_no"))
_study("attach_forward", [_daily, _forward, _attached], "SELECT date, ticker, signal, direction, " + _by_h("ret", "abn").replace(" ", ", ") + " FROM attached", _by_h("ret", "abn"))
_study("signal_stats", [_daily, _forward, _attached, backtest.stats_ctes()], "SELECT * FROM stats", _by_h("abn") + " hit tstat net_per_trade net_daily_equiv", by=backtest.per_signal_stats)
_study("decay_by_year", [_daily, _forward, _attached, backtest.decay_ctes()], "SELECT * FROM decay", "abn_own", by=backtest.decay)
_study(
    "newey_west",
    [_daily, "lone AS (SELECT 1 AS one, date, mkt_cc AS x FROM by_date)"],
    backtest.newey_west("one", "lone", "x", "5"),
    "tstat",
)
for _name, _select, _doubles in (("family_portfolio", "SELECT * FROM portfolio", "ret"), ("family_summary", backtest.SUMMARY, "mean_bp sharpe")):
    _study(_name, [_daily, backtest.steps_cte("duckdb"), backtest.portfolio_ctes()], _select, _doubles, [_daily, backtest.steps_cte("spark"), backtest.portfolio_ctes()])


# shapes, fusion, studies
_FUSED = tuple(STUDIED)
register("lmw_extrema", lambda spark, sf_dir: shapes.extrema_shapes(bars.walk(spark, sf_dir)))
register("cup_handle", lambda spark, sf_dir: shapes.cup_handle(bars.walk(spark, sf_dir)))
_pivot = fusion.pivot_ctes(_FUSED)
_linear = fusion.linear_ctes(_FUSED)
_scores = " ".join(f"f_{f}" for f in _FUSED)
_study("feature_pivot", [_daily, _pivot], f"SELECT date, ticker, n_active, {_scores.replace(' ', ', ')} FROM pivoted", _scores)
_study("zsum_portfolio", [_daily, _forward, _pivot, _linear, fusion.sides_ctes(10)], "SELECT * FROM book", "gross net")
_study(
    "topk_overlap_portfolio",
    [_daily, _forward, _pivot, _linear, backtest.steps_cte("duckdb"), fusion.frontier_ctes()],
    "SELECT * FROM frontier",
    "conviction_q rt_bps mean_bp sharpe",
    [_daily, _forward, _pivot, _linear, backtest.steps_cte("spark"), fusion.frontier_ctes()],
)


def _walked(spark, sf_dir):
    panel, found = studied(spark, sf_dir)
    return fusion.walk_forward(fusion.training_rows(panel, found, _FUSED), _FUSED, trees=5, every=12)


def _importance(spark, sf_dir):
    _, model, rows, inputs = _walked(spark, sf_dir)
    return fusion.permutation_importance(model, rows, inputs, repeats=1)


def _events(spark, sf_dir):
    return studies.crash_events(bars.walk(spark, sf_dir), warm_up=120)


register("walkforward_gbt", lambda spark, sf_dir: _walked(spark, sf_dir)[0].select("date", "ticker", "score"))
register("permutation_importance", _importance)
_event_ctes = studies.events_sql("bars", warm_up=120)
_knn_ctes = studies.analogs_sql(least=60)


def _of_events(select: str, more: list[str] | None = None) -> str:
    return render("WITH RECURSIVE " + ", ".join([_BARS, *_event_ctes, *(more or [])]) + " " + select, "duckdb")


register("crash_events", _events, _of_events("SELECT * FROM events"), studies.EVENT_DOUBLES)
register("cohort_table", lambda spark, sf_dir: studies.cohorts(_events(spark, sf_dir)), _of_events(studies.cohort_sql().format(events="events")), "fwd5_bps fwd10_bps p_bounce5 p90_5d_pct p10_5d_pct p_second_knife")
register("knn_past_cohort", lambda spark, sf_dir: studies.analogs(_events(spark, sf_dir), least=60), _of_events("SELECT * FROM predicted", _knn_ctes), "y knn_pred")


def _forks(spark, sf_dir):
    events = kept(_events(spark, sf_dir), "events")
    return studies.forks(events, studies.analogs(events, least=60), studies.model_forecasts(events, trees=5, least=60, every=12))


register("crash_forks", _forks)
register("analog_correlation", lambda spark, sf_dir: studies.information_coefficient(studies.analogs(_events(spark, sf_dir), least=60)), _of_events("SELECT corr(knn_pred, y) AS ic FROM predicted", _knn_ctes), "ic")
_PATHS = (
    "SELECT CAST(p.date_idx - a.date_idx AS INT) AS \"offset\", avg(ln(p.close) - ln(a.close)) AS path FROM events e JOIN dense a ON a.date = e.date AND a.ticker = e.ticker "
    "JOIN dense p ON p.ticker = e.ticker AND p.date_idx BETWEEN a.date_idx - 15 AND a.date_idx + 20 GROUP BY 1"
)
register("average_path", lambda spark, sf_dir: studies.average_path(bars.walk(spark, sf_dir), _events(spark, sf_dir)), _of_events(_PATHS), "path")
_oracle_ctes, _ = studies.oracle_ctes("bars")
for _name, _select, _doubles in (
    ("oracle_top3", studies.TOP_TABLE, "return_pct rvol_that_day gap_that_day_pct exante_rvol exante_news_3d exante_mom21 exante_prox52 exante_vol20 exante_compression"),
    ("winner_profile", studies.profile_select(), "winners universe lift"),
    ("random_baseline", foresight.chance_select(), "random3_avg_daily_pct random_hit_rate"),
    ("oracle_ceiling", studies.CEILING, "oracle_avg_daily_pct universe_avg_daily_pct news_share_of_top3"),
):
    register(_name, lambda spark, sf_dir, select=_select: studies.winners(bars.walk(spark, sf_dir), select), render("WITH " + ", ".join([_BARS, *_oracle_ctes]) + " " + _select, "duckdb"), _doubles)


def _honest(spark, sf_dir):
    """The table has 357 bars a ticker: fewer rows than the operator asks of a model by default. Trees as in walkforward_gbt."""
    return foresight.honest_picks(foresight.chances(bars.walk(spark, sf_dir), trees=5, least=2000, every=12))


register("honest_picks", _honest)
register("oracle_summary", lambda spark, sf_dir: foresight.oracle_summary(kept(bars.walk(spark, sf_dir), "bars"), _honest(spark, sf_dir)))
_study("sample_trades", [_daily, _forward, _attached, samples.sample_ctes()], "SELECT * FROM samples", "strength ret_5 entry_price exit_price")
register("treadmill", lambda spark, sf_dir: spark.sql(studies.TREADMILL), studies.TREADMILL, "net_daily_bps net_annual_pct")
register(
    "required_skill",
    lambda spark, sf_dir: spark.sql(studies.REQUIRED_SKILL, panel=bars.walk(spark, sf_dir)),
    f"WITH {_BARS} " + studies.REQUIRED_SKILL.format(panel="bars"),
    "per_trade_edge_bps hit_rate_needed",
)
register("day_traders", lambda spark, sf_dir: studies.annual_distribution(studies.day_traders(bars.walk(spark, sf_dir))))


def _family_returns(spark, sf_dir):
    panel, found = studied(spark, sf_dir)
    return backtest.family_portfolio(panel, found)


register("bootstrap", lambda spark, sf_dir: studies.bootstrap(_family_returns(spark, sf_dir).where("family = 'candles'")))
_CURVE = "SELECT date, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS equity FROM portfolio WHERE family = 'candles'"
_study(
    "equity_curve",
    [_daily, backtest.steps_cte("duckdb"), backtest.portfolio_ctes()],
    f"SELECT date, equity, equity / max(equity) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM ({_CURVE}) c",
    "equity drawdown",
    [_daily, backtest.steps_cte("spark"), backtest.portfolio_ctes()],
)
register("calibration", lambda spark, sf_dir: files.estimates(bars.walk(spark, sf_dir)), f"WITH {_BARS} SELECT * FROM ({files.estimates_sql('duckdb', 'bars')})", "mu overnight_var_share gap_std gap_kurtosis volume_abs_ret_beta range_var_ratio")
_SMALL = simulator.Market(n_stocks=12, years=2.2)
register("simulate", lambda spark, sf_dir: simulator.simulate(spark, _SMALL))


def _recovery(spark, sf_dir):
    made = kept(simulator.simulate(spark, _SMALL), "simulated")
    return recovery.ground_truth_recovery(signals.detect(made.drop(*simulator.TRUTH), rules.rules("gaps", "anchors", "candles")), made)


register("ground_truth_recovery", _recovery)
register("chart_gbm", lambda spark, sf_dir: learned.chart_signals(bars.walk(spark, sf_dir), trees=5))
register("streaming_bars", lambda spark, sf_dir: stream_bars.hourly_bars(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("hour", F.col("hour").cast("timestamp_ntz")), f"SELECT * FROM ({HOURLY})", _PRICES)
