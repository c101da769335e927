"""Picks before the open, models by month, random traders, sample trades and sinks, held against plain versions."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.operators import foresight, fusion, samples, studies
from barline.sources import sinks

from . import panels


@pytest.fixture(scope="module")
def panel(spark):
    return panels.frame(spark, panels.walk(60, 4)).persist()


def test_honest_picks_are_the_highest_chances_and_hits_are_common_names(spark):
    day, rows = dt.date(2024, 1, 2), []
    for t in range(4):
        for j in range(12 if t != 2 else 9):  # too few names on the third date
            rows.append((day + dt.timedelta(days=t), t + 1, 4, f"T{j:02}", None if j == 11 else 0.01 * j - 0.02 * t, float(j in (1, 5, 11)), (j * 7 + t) % 5 / 10))
    scored = spark.createDataFrame(rows, "date date, date_idx int, final int, ticker string, oc double, won double, chance double")
    got = {r["date"]: r for r in foresight.honest_picks(scored, top=3, days=3, cost=0.001).collect()}
    assert sorted(got) == [day + dt.timedelta(days=t) for t in (1, 3)]  # the first date is before the last three
    for date, r in got.items():
        own = sorted((x for x in rows if x[0] == date), key=lambda x: (-x[6], x[3]))[:3]
        assert r["picked"] == ",".join(x[3] for x in own) and r["prob"] == ",".join(f"{x[6]:.3f}" for x in own)
        assert r["hits_in_actual_top3"] == sum(x[5] == 1 for x in own)
        assert r["net_return_pct"] == pytest.approx(100 * (np.mean([x[4] for x in own if x[4] is not None]) - 0.001))


def test_models_by_month_see_earlier_months_only(spark):
    rows = spark.createDataFrame([(dt.date(2024, m, d), "A", dt.date(2024, m, 1), float(m) if d != 3 else None) for m in range(1, 7) for d in (1, 2, 3)], "date date, ticker string, month date, y double")
    seen = []

    class Model:
        def __init__(self, last):
            self.last = last

        def transform(self, now):
            return now.withColumn("prediction", F.lit(self.last))

    class Stub:
        def getLabelCol(self):
            return "y"

        def fit(self, past):
            last, n = past.agg(F.max("y"), F.count("*")).first()
            seen.append((last, n))
            return Model(last)

    scored, _ = fusion.by_month(rows, Stub(), least=3, every=2, most=5)
    assert seen == [(2.0, 4), (4.0, 5)]  # from March on, every other month, the most recent rows with a label
    assert {r["month"].month: r["prediction"] for r in scored.collect()} == {3: 2.0, 4: 2.0, 5: 4.0, 6: 4.0}
    assert fusion.by_month(rows, Stub(), least=100) == (None, None)


def test_random_traders_of_equal_days_make_what_the_day_makes(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=t), f"T{j}", 100.0, 103.0, 99.0, 102.0, 1000.0, 0, 0, 0.0, 101.0, 99.5) for t in range(40) for j in range(4)]
    pnl = studies.day_traders(panels.frame(spark, rows), n_traders=6, days=30, k=3, cost_bps=5.0)
    got = {v: [r["pnl"] for r in pnl.where(F.col("variant") == v).collect()] for v in studies.TRADERS}
    assert all(len(x) == 6 for x in got.values())
    for name, (hot, adjusted, _) in studies.TRADERS.items():
        if not hot:
            assert got[name] == pytest.approx([30 * ((0.0 if adjusted else 0.02) - 0.0005)] * 6)
    assert got["hot movers (attention bias), adj"] == [0.0] * 6  # no name stands out, no day is traded
    few = panels.frame(spark, [r for r in rows if r[1] in ("T0", "T1")])
    assert {r["pnl"] for r in studies.day_traders(few, n_traders=3, days=30, k=3).collect()} == {0.0}  # fewer names than picks


def test_forks_take_what_each_forecast_picks(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), f"T{i % 3}", 0.03 if i % 2 else -0.01, i % 2, i % 2, 1.0) for i in range(24)]
    events = spark.createDataFrame(rows, "date date, ticker string, fwd5 double, reversal_bar int, news_crash int, climax_rvol double")
    forecast = lambda name, p: events.select("date", "ticker", F.when(F.expr(p), 0.02).otherwise(0.0).alias(name))
    got = {r["strategy"]: r for r in studies.forks(events, forecast("knn_pred", "fwd5 < 0"), forecast("gbm_pred", "fwd5 > 0"), cost=0.001).collect()}
    assert {k: r["n_trades"] for k, r in got.items()} == {"catch ALL knives": 24, "model fork (GBM pred > +100bp)": 12, "analog fork (kNN cohort > +100bp)": 12}
    assert got["model fork (GBM pred > +100bp)"]["avg_5d_net_bps"] == pytest.approx(290) and got["analog fork (kNN cohort > +100bp)"]["hit"] == 0


def test_sample_trades_are_the_strongest_of_each_family_and_have_their_bars(spark, panel):
    dates = sorted({r["date"] for r in panel.select("date").collect()})
    made = [(dates[t], f"T{t % 4}", family, f"{family}_x", 1, float(s), 5) for t, family, s in ((10, "candles", 1), (11, "candles", 9), (12, "candles", 3), (20, "gaps", 2), (21, "gaps", 8), (22, "gaps", 8), (30, "levels", 99))]
    signals = spark.createDataFrame(made, "date date, ticker string, family string, signal string, direction int, strength double, horizon int")
    close = {(r["date"], r["ticker"]): r for r in panel.collect()}
    trades = samples.sample_trades(panel, signals).persist()
    got = sorted(trades.collect(), key=lambda r: r["number"])
    assert got and all(r["family"] in ("gaps", "candles") for r in got)  # families that aren't shown have none
    assert [r["family"] for r in got] == sorted((r["family"] for r in got), key=samples.SHOWN.index)
    for r in got:
        t = dates.index(r["date"])
        assert r["entry_date"] == dates[t + 1] and r["exit_date"] == dates[t + 5]
        assert r["entry_price"] == close[r["entry_date"], r["ticker"]]["open"] and r["exit_price"] == close[r["exit_date"], r["ticker"]]["close"]
        rivals = [x for x in made if x[2] == r["family"] and x[5] > r["strength"]]
        for x in rivals:  # a stronger one of the family fell on the other side
            u = dates.index(x[0])
            assert (close[dates[u + 5], x[1]]["close"] > close[dates[u + 1], x[1]]["open"]) != (r["ret_5"] > 0)
    bars = samples.trade_bars(panel, trades, before=4, after=6).collect()
    assert all(b["date"] == dates[dates.index(next(r["date"] for r in got if r["number"] == b["number"])) + b["step"]] for b in bars)
    assert len(bars) == 11 * len(got)


def test_sinks_write_tables_and_a_summary(spark, panel, tmp_path):
    some = panel.select("date", "ticker", "close").where("ticker = 'T1'")
    for _ in range(2):  # a second run replaces the first
        sinks.tables({"closes": some}, str(tmp_path))
        sinks.summary(spark, {"n": some.count(), "by": sinks.nested(some.groupBy("ticker").count(), "ticker"), "of": sinks.nested(some.limit(0))}, f"{tmp_path}/summary.json")
    back = spark.read.option("header", True).schema(some.schema).csv(f"{tmp_path}/closes.csv")
    assert sorted(back.collect()) == sorted(some.collect())
    assert json.loads((tmp_path / "summary.json").read_text()) == {"n": 60, "by": {"T1": {"count": 60}}, "of": None}
