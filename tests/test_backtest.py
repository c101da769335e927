"""Forward returns, costs, event studies, portfolios, studies and the simulator."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest

from barline.operators import backtest, features, fusion, interaction, recovery, rules, signals, studies
from barline.sources import files, simulator

from .panels import frame, walk

ROWS = walk(200, 5, seed=21)
DATES = sorted({r[0] for r in ROWS})
SIGNALS = "date date, ticker string, family string, signal string, direction int, strength double, horizon int"


@pytest.fixture(scope="module")
def panel(spark):
    return frame(spark, ROWS).persist()


def price(column: str) -> pd.DataFrame:
    at = {"open": 2, "close": 5}[column]
    return pd.DataFrame([(r[0], r[1], r[at]) for r in ROWS], columns=["d", "t", "x"]).pivot(index="d", columns="t", values="x")


def test_forward_returns_and_benchmarks_by_hand(panel):
    c, o = price("close"), price("open")
    cc, oc = (c / c.shift(1) - 1).mean(axis=1).fillna(0), (c / o - 1).mean(axis=1)
    got = backtest.run(panel, [backtest.daily_ctes(), backtest.forward_ctes()], "SELECT f.*, m.mkt_sc_5, m.mkt_no_5, m.mkt_no_1 FROM forward f JOIN market m ON m.date = f.date").toPandas()
    r = got[(got.date == DATES[50]) & (got.ticker == "T2")].iloc[0]
    assert r.no_1 == pytest.approx(c["T2"].iloc[51] / o["T2"].iloc[51] - 1)
    assert r.no_5 == pytest.approx(c["T2"].iloc[55] / o["T2"].iloc[51] - 1)
    assert r.sc_1 == pytest.approx(c["T2"].iloc[51] / c["T2"].iloc[50] - 1)
    assert r.mkt_sc_5 == pytest.approx(np.prod(1 + cc.iloc[51:56]) - 1)
    assert r.mkt_no_5 == pytest.approx((1 + oc.iloc[51]) * np.prod(1 + cc.iloc[52:56]) - 1)
    assert r.mkt_no_1 == pytest.approx(oc.iloc[51])
    assert got[got.date == DATES[-1]].no_1.isna().all()


def test_direction_and_entry_set_the_sign(spark, panel):
    found = spark.createDataFrame([(DATES[50], "T1", "x", "some_rule", -1, 1.0, 1), (DATES[50], "T1", "x", "gap_rule", 1, 1.0, 1)], SIGNALS)
    got = {r["signal"]: r for r in backtest.attach_forward(panel, found).collect()}
    c, o = price("close")["T1"], price("open")["T1"]
    assert got["some_rule"]["ret_1"] == pytest.approx(-(c.iloc[51] / o.iloc[51] - 1))
    assert got["gap_rule"]["ret_1"] == pytest.approx(c.iloc[51] / c.iloc[50] - 1)


def test_costs_take_a_round_trip_per_trade(spark, panel):
    found = spark.createDataFrame([(DATES[50], "T1", "x", "a", 1, 1.0, 5), (DATES[60], "T2", "x", "a", -1, 1.0, 5)], SIGNALS)
    total = lambda cost: backtest.family_portfolio(panel, found, cost).agg({"ret": "sum"}).first()[0]
    assert total(0.0) - total(0.0022) == pytest.approx(2 * 0.0022)


def slow_newey_west(x, lags):
    e = x - x.mean()
    n = len(x)
    s = e @ e / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, min(lags, n - 1) + 1))
    return x.mean() / math.sqrt(max(s, 1e-18) / n)


def test_newey_west(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0.001, 0.01, 2000)
    df = spark.createDataFrame([("g", dt.date(2000, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)] + [("few", dt.date(2000, 1, i + 1), 1.0) for i in range(5)], "g string, date date, x double")
    got = {r["g"]: r["tstat"] for r in spark.sql(backtest.newey_west("g", "{df}", "x", "6"), df=df).collect()}
    assert got["g"] == pytest.approx(slow_newey_west(x, 6)) and 2 < got["g"] < 8 and got["few"] is None


def test_event_study_table(panel):
    found = signals.detect(panel, rules.rules("candles", "gaps"))
    stats = backtest.per_signal_stats(panel, found).toPandas()
    flat = backtest.attach_forward(panel, found).toPandas()
    for name in stats.sort_values("n").signal.tail(3):
        g, r = flat[flat.signal == name], stats[stats.signal == name].iloc[0]
        own = g[f"abn_{r.horizon}"].dropna()
        assert r.n == len(g) and r.hit == pytest.approx((own > 0).mean()) and r.net_per_trade == pytest.approx(own.mean() - 0.0015)
        daily = g.dropna(subset=[f"abn_{r.horizon}"]).groupby("date")[f"abn_{r.horizon}"].mean().sort_index().to_numpy()
        assert r.tstat == pytest.approx(slow_newey_west(daily, int(r.horizon) + 1))
    assert list(stats.tstat.dropna()) == sorted(stats.tstat.dropna(), reverse=True)
    assert backtest.decay_by_year(panel, found).count() == len(stats)


def test_snapping_takes_the_nearest_and_the_lower_of_two(spark):
    got = [spark.sql(f"SELECT {backtest.snap(str(h))}").first()[0] for h in range(1, 24)]
    want = [min((1, 2, 3, 5, 10, 20), key=lambda x: (abs(x - h), x)) for h in range(1, 24)]
    assert got == want


def test_interaction_cells_add_up(panel):
    rows = interaction.gap_interaction(panel).toPandas()
    assert (rows.n >= 30).all() and set(rows.rvol) <= {"all", "lowV", "midV", "highV"}
    assert interaction.breakout_interaction(panel).count() <= 8


def test_linear_book_and_past_scores(spark, panel):
    families = ("gaps", "candles", "trend")
    found = signals.detect(panel, rules.rules(*families)).persist()
    book = fusion.linear_book(panel, found, 2, families).toPandas()
    assert len(book) == len(DATES) and (book.gross - book.net).round(6).isin([0, 0.0015]).all()
    cut = frame(spark, [r for r in ROWS if r[0] < DATES[-45]])
    walked = [fusion.walk_forward(fusion.training_rows(p, s, families), families, trees=2, least=200)[0].toPandas() for p, s in ((panel, found), (cut, signals.detect(cut, rules.rules(*families))))]
    both = walked[0].merge(walked[1], on=["date", "ticker"], suffixes=("", "_cut"))
    full_months = both[both.date < DATES[-45].replace(day=1)]
    assert len(full_months) and np.allclose(full_months.score, full_months.score_cut, atol=1e-10)
    assert len(fusion.frontier(panel, found, families).collect()) == 40


def test_cooldown_is_greedy(spark):
    closes, t = [100.0] * 20, 0
    for drop_at in (20, 24, 31, 60):  # the second falls within ten rows of the first, the third does not
        closes += [closes[-1]] * (drop_at - len(closes)) + [closes[-1] * 0.8]
    closes += [closes[-1]] * (110 - len(closes))
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), "A", c, c, c, c, 1.0, 0, 0, None, None, None) for i, c in enumerate(closes)]
    got = studies.crash_events(frame(spark, rows), warm_up=0).orderBy("date").collect()
    days = [(r["date"] - dt.date(2020, 1, 1)).days for r in got]
    crashed = [i for i in range(5, 110) if closes[i] / closes[i - 5] - 1 <= -0.15 or (i >= 10 and closes[i] / closes[i - 10] - 1 <= -0.20)]
    want, last = [], -99
    for i in crashed:
        if i - last >= 10:
            want.append(i)
            last = i
    assert days == [i for i in want if i + 21 < 110]


def test_analogs_are_the_nearest_past_events(spark):
    rng = random.Random(1)
    rows = [(dt.date(2020, 1 + i // 40, 1 + i % 28), f"T{i}", rng.random(), rng.random(), rng.gauss(0, 1)) for i in range(160)]
    events = spark.createDataFrame(rows, "date date, ticker string, a double, b double, y double")
    got = {r["ticker"]: r["knn_pred"] for r in studies.analogs(events, ("a", "b"), "y", k=5, least=30).collect()}
    want = {}
    for d, t, a, b, _ in rows:
        past = np.array([r[2:] for r in rows if r[0].replace(day=1) < d.replace(day=1)])
        if len(past) >= 30:
            sd = past[:, :2].std(0) + 1e-9
            near = np.argsort((((past[:, :2] - [a, b]) / sd) ** 2).sum(1))[:5]
            want[t] = past[near, 2].mean()
    assert got == pytest.approx(want)


def test_resampling_and_traders_are_seeded(panel):
    daily = panel.groupBy("date").agg({"close": "avg"}).withColumnRenamed("avg(close)", "ret")
    a, b = (sorted(tuple(r) for r in studies.bootstrap(daily, n_draws=20).collect()) for _ in range(2))
    mean = daily.agg({"ret": "avg"}).first()[0]
    assert a == b and abs(np.mean([x for _, x in a]) / mean - 1) < 0.1
    first, again = (studies.day_traders(panel, 20, 60, k=1).toPandas().sort_values(["variant", "trader"]) for _ in range(2))
    assert (first.groupby("variant").size() == 20).all() and (first.groupby("variant").pnl.std() > 0).all() and first.pnl.tolist() == again.pnl.tolist()


def test_simulated_markets(spark):
    made = simulator.simulate(spark, simulator.Market(n_stocks=10, years=1.2)).persist()
    got = made.toPandas()
    assert len(got) == 10 * round(252 * 1.2) and (got.high >= got[["open", "close"]].max(axis=1) - 1e-9).all() and (got.low <= got[["open", "close"]].min(axis=1) + 1e-9).all()
    again = simulator.simulate(spark, simulator.Market(n_stocks=10, years=1.2)).toPandas()
    keys = ["ticker", "date"]
    pd.testing.assert_frame_equal(got.sort_values(keys).reset_index(drop=True), again.sort_values(keys).reset_index(drop=True))
    by = got.sort_values(keys)
    night, day = by.open / by.groupby("ticker").close.shift(1) - 1, by.close / by.open - 1
    quiet = by.catalyst == 0
    assert 0.4 < (np.sign(night[quiet]) == np.sign(day[quiet])).mean() < 0.6
    placebo = recovery.ground_truth_recovery(signals.detect(made.drop(*simulator.TRUTH), rules.rules("candles")), made).toPandas()
    assert (np.average(placebo.mean_true_drift_bps.abs(), weights=placebo.n) < placebo.baseline_abs_bps.iloc[0]).all()


def test_files(spark, tmp_path):
    (tmp_path / "abc.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,100\n2020-01-03,1.5,2,1,,90\nbad,1,1,1,1,1\n2020-01-06,2,3,1,2.5,80\n")
    prices = files.daily_csv(spark, f"{tmp_path}/abc.csv", "abc")
    assert [r["close"] for r in prices.orderBy("date").collect()] == [1.5, 2.5]
    assert files.daily_csv(spark, f"{tmp_path}/abc.csv").first()["ticker"] == "ABC"
    (tmp_path / "news.json").write_text('{"timeline": [{"data": [' + ", ".join(f'{{"date": "202001{d:02d}T000000Z", "value": {50 if d == 28 else 1 + d % 3}}}' for d in range(1, 31)) + "]}]}")
    flags = files.news_flags(files.news_json(spark, f"{tmp_path}/news.json").selectExpr("date", "value", "'ABC' AS ticker"), ["ticker"])
    assert [r["date"].day for r in flags.where("flag = 1").collect()] == [28]
    panel = files.assemble(prices, flags)
    assert panel.columns == list(features.PANEL) and panel.where("catalyst = 0").count() == 2
    assert not signals.detect(panel, rules.rules("fundamentals", "orb_30min_up")).collect()  # no quality, no range: nothing
    (tmp_path / "list.txt").write_text("A  B\nC\n")
    assert {r[0] for r in files.ticker_list(spark, f"{tmp_path}/list.txt").collect()} == {"A", "B", "C"}
