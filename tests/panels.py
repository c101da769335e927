"""Small panels for tests."""

from __future__ import annotations

import datetime as dt
import random

COLUMNS = "date date, ticker string, open double, high double, low double, close double, volume double, catalyst int, news_sign int, quality double, or30_high double, or30_low double"


def walk(n_days: int = 330, tickers: int = 6, seed: int = 3, ragged: bool = False):
    """A wild walk, so that most rules fire."""
    rng, rows = random.Random(seed), []
    start = dt.date(2020, 1, 1)
    for j in range(tickers):
        price = 40.0 + 20 * j
        for t in range(n_days):
            o = price * (1 + rng.gauss(0, 0.02))
            c = o * (1 + rng.gauss(0, 0.03))
            hi, lo = max(o, c) * (1 + abs(rng.gauss(0, 0.01))), min(o, c) * (1 - abs(rng.gauss(0, 0.01)))
            news = int(rng.random() < 0.1)
            row = (start + dt.timedelta(days=t), f"T{j}", *(round(x, 4) for x in (o, hi, lo, c)), float(int(rng.lognormvariate(9, 0.8))), news, news * rng.choice([-1, 1]), float(j), round(o * 1.01, 4), round(o * 0.99, 4))
            if not (ragged and j == 1 and t in (100, 101, 102)):
                rows.append(row)
            price = c
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)
