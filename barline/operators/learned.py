"""The learned family: small images of recent bars, scored by boosted trees out of sample.

An image is 64 by 60 grey levels of the last 20 bars: open tick, range, close tick, a line of the moving average, and
volume below. Max-pooled four by four it makes 240 features. Trees learn, on the first part of the calendar, whether
the next five rows rise; a gap of five rows keeps labels out of the scored part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS, HEIGHT, WIDTH, VOLUME_HEIGHT, POOL = 20, 64, 60, 11, 4
AHEAD, STEP, SPLIT, MAX_TRAIN = 5, 5, 0.4, 120_000


def image(open_, high, low, close, average, volume) -> np.ndarray:
    """The grey levels of one window, or none where its range is nil or a value is missing."""
    stack = np.array([open_, high, low, close, average], float)
    low_edge, high_edge = np.nanmin(stack), np.nanmax(stack)
    img = np.zeros((HEIGHT, WIDTH), np.float32)
    if not np.isfinite(stack).all() or high_edge <= low_edge:
        return img
    body = HEIGHT - VOLUME_HEIGHT - 2
    y = np.rint((body - 1) * (1 - (stack - low_edge) / (high_edge - low_edge))).astype(int)
    top = np.nanmax(volume) if np.isfinite(volume).any() else 0
    for i in range(ROWS):
        img[y[4, i], 3 * i : 3 * i + 3] = np.maximum(img[y[4, i], 3 * i : 3 * i + 3], 0.5)
        img[y[0, i], 3 * i] = 1
        img[y[1, i] : y[2, i] + 1, 3 * i + 1] = 1
        img[y[3, i], 3 * i + 2] = 1
        if top > 0 and np.isfinite(volume[i]):
            n = int(round(VOLUME_HEIGHT * volume[i] / top))
            if n:
                img[HEIGHT - n :, 3 * i + 1] = 1
    return img


def pooled(img: np.ndarray) -> np.ndarray:
    return img.reshape(HEIGHT // POOL, POOL, WIDTH // POOL, POOL).max((1, 3)).ravel()


def windows(panel: DataFrame) -> DataFrame:
    """date, date_idx, ticker, features (240 numbers), up (null where unknown): windows of STEP rows apart."""
    w = Window.partitionBy("ticker").orderBy("date")
    frame = w.rowsBetween(-(ROWS - 1), 0)
    calendar = panel.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("date_idx"))
    average = F.avg("close").over(frame)
    rows = panel.join(calendar, "date").withColumn("average", average)
    cols = ("open", "high", "low", "close", "average", "volume")
    rows = rows.select("date", "date_idx", "ticker", *(F.collect_list(c).over(frame).alias(c) for c in cols), (F.lead("close", AHEAD).over(w) / F.col("close") > 1).cast("double").alias("up"))
    rows = rows.where((F.col("date_idx") % STEP == 0) & F.forall(F.array(*(F.size(c) == ROWS for c in cols)), lambda x: x))

    def render(batches):
        for pdf in batches:
            pdf["features"] = [pooled(image(*(np.asarray(r[c], float) for c in cols))).astype(float) for _, r in pdf.iterrows()]
            yield pdf[["date", "date_idx", "ticker", "features", "up"]]

    return rows.mapInPandas(render, "date date, date_idx int, ticker string, features array<double>, up double")


def chart_signals(panel: DataFrame, trees: int = 20, depth: int = 3, split: float = SPLIT) -> DataFrame:
    """gbm_long and gbm_short: of each scored date, the top and the bottom tenth by the chance of a rise."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = windows(panel).withColumn("x", array_to_vector("features")).persist()
    last = rows.agg(F.max("date_idx")).first()[0]
    cut = int((last or 0) * split)
    train = rows.where((F.col("date_idx") <= cut - AHEAD) & F.col("up").isNotNull())
    n = train.count()
    if n > MAX_TRAIN:  # whole days, by a hash of the date
        train = train.where(F.pmod(F.xxhash64("date"), F.lit(1 << 20)) < int((1 << 20) * MAX_TRAIN / n))
    if not n or train.select("up").distinct().count() < 2:
        return rows.selectExpr("date", "ticker", "'ml' AS family", "'' AS signal", "0 AS direction", "0D AS strength", "5 AS horizon").where("false")
    model = GBTClassifier(featuresCol="x", labelCol="up", maxIter=trees, maxDepth=depth, seed=0).fit(train)
    scored = model.transform(rows.where(F.col("date_idx") > cut)).select("date", "ticker", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
    day = Window.partitionBy("date")
    marked = scored.withColumn("hi", F.percentile("p", F.lit(0.9)).over(day)).withColumn("lo", F.percentile("p", F.lit(0.1)).over(day))
    way = F.when(F.col("p") >= F.col("hi"), 1).when(F.col("p") <= F.col("lo"), -1)
    return marked.withColumn("direction", way).where("direction IS NOT NULL").select(
        "date", "ticker", F.lit("ml").alias("family"), F.when(F.col("direction") > 0, "gbm_long").otherwise("gbm_short").alias("signal"), "direction", F.when(F.col("direction") > 0, F.col("p")).otherwise(1 - F.col("p")).alias("strength"), F.lit(AHEAD).alias("horizon")
    )
