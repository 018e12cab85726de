"""Golden values and properties of the indicators."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators as ind

# Fixed inputs with known results.
RSI_CLOSES = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.1, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28, 46, 46.03]
RSI = [70.46413502109705, 66.24961855355505, 66.48094183471265]
ATR_BARS = [(48.7, 47.79, 48.16), (48.72, 48.14, 48.61), (48.9, 48.39, 48.75), (48.87, 48.37, 48.63), (48.82, 48.24, 48.74), (49.05, 48.64, 49.03), (49.2, 48.94, 49.07), (49.35, 48.86, 49.32), (49.92, 49.5, 49.91), (50.19, 49.87, 50.13), (50.12, 49.2, 49.53), (49.66, 48.9, 49.5), (49.88, 49.43, 49.75), (50.19, 49.73, 50.03), (50.36, 49.26, 50.31), (50.57, 50.09, 50.52), (50.65, 50.3, 50.41)]
ATR = [0.5542857142857146, 0.5932653061224494, 0.5851749271137028, 0.5683767180341527]
CCI_BARS = [(24.2, 23.85, 23.89), (24.07, 23.72, 23.95), (24.04, 23.64, 23.67), (23.87, 23.37, 23.78), (23.67, 23.46, 23.5), (23.59, 23.18, 23.32), (23.8, 23.4, 23.75), (23.8, 23.57, 23.79), (24.3, 24.05, 24.14), (24.15, 23.77, 23.81), (24.05, 23.6, 23.78), (24.06, 23.84, 23.86), (23.88, 23.64, 23.7), (25.14, 23.94, 24.96), (25.20, 24.74, 24.88), (25.07, 24.77, 24.96), (25.22, 24.9, 25.18), (25.37, 24.93, 25.07), (25.36, 24.96, 25.27), (25.26, 24.93, 25), (24.82, 24.21, 24.46), (24.44, 24.21, 24.28)]
CCI = [102.19852632840085, 30.770139381053642, 6.498977012877848]
ADX_BARS = [(44.53, 43.98, 44.52), (44.93, 44.36, 44.65), (45.39, 44.70, 45.22), (45.70, 45.13, 45.45), (45.63, 44.89, 45.49), (45.52, 44.20, 44.24), (44.71, 44.00, 44.62), (45.15, 43.76, 45.15), (45.65, 44.46, 44.54), (45.87, 45.13, 45.66), (45.99, 45.27, 45.95), (46.35, 45.80, 46.33), (46.61, 46.10, 46.31), (46.47, 45.77, 45.94), (46.30, 45.14, 45.60), (45.98, 44.97, 45.70), (46.68, 46.10, 46.56), (46.59, 46.14, 46.36), (46.88, 46.39, 46.83), (46.81, 46.41, 46.72), (46.74, 45.94, 46.65), (47.08, 46.68, 46.97), (46.84, 46.17, 46.56), (45.81, 45.10, 45.29), (45.13, 44.35, 44.94), (44.96, 44.61, 44.62), (45.01, 44.20, 44.70), (45.67, 44.93, 45.27), (45.71, 45.01, 45.44)]


def arrays(bars):
    return (np.array(x, float) for x in zip(*bars))


def test_rsi():
    got = ind.rsi_values(np.array(RSI_CLOSES, float))
    assert np.isnan(got[:14]).all() and got[14:] == pytest.approx(RSI)


def test_atr():
    got = ind.atr_values(*arrays(ATR_BARS))
    assert np.isnan(got[:13]).all() and got[13:] == pytest.approx(ATR)


def test_adx():
    plus, minus = ind.di_values(*arrays(ADX_BARS))
    assert (plus[14], minus[14]) == pytest.approx((25.163934426229517, 17.13114754098364))
    assert ind.adx_values(ind.dx_values(plus, minus))[27:] == pytest.approx([21.039420392257284, 20.425066591350014])


def frame(spark, bars, ticker="A"):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([("X", ticker, day + dt.timedelta(i), float(h), float(low), float(c)) for i, (h, low, c) in enumerate(bars)], "exchange string, symbol string, period_date date, high double, low double, close double")


def test_cci(spark):
    got = [r["cci"] for r in ind.cci(frame(spark, CCI_BARS)).orderBy("period_date").collect()]
    assert got[:19] == [None] * 19 and got[19:] == pytest.approx(CCI)


def test_short_tickers_and_order(spark):
    rng = random.Random(1)
    bars = [(c + rng.random(), c - rng.random(), c) for c in (100 + rng.gauss(0, 3) for _ in range(60))]
    df = frame(spark, bars).unionByName(frame(spark, bars[:5], "SHORT"))
    one = {(r["symbol"], r["period_date"]): r for r in ind.recursive(df).collect()}
    two = {(r["symbol"], r["period_date"]): r for r in ind.recursive(df.orderBy(F.rand(1)).repartition(7)).collect()}
    assert one == two
    assert all(r["rsi"] is None and r["adx"] is None and r["st"] is None for k, r in one.items() if k[0] == "SHORT")
    full = [one[k] for k in sorted(one) if k[0] == "A"]
    assert all(0 <= r["rsi"] <= 100 for r in full if r["rsi"] is not None)
    assert [r["ema5"] is None for r in full] == [i < 4 for i in range(60)]
    assert [r["macd"] is None for r in full] == [i < 26 for i in range(60)]
    bb = ind.bollinger(df).where("bb_mid is not null").collect()
    assert len(bb) == 40 and all(r["bb_low"] <= r["bb_mid"] <= r["bb_high"] for r in bb)


def test_ema_variants():
    c = np.arange(1.0, 31.0)
    a = ind.ema_values(c, 5, variant="reference")
    b = ind.ema_values(c, 5, variant="textbook")
    assert a[4] == b[4] == 3 and a[5] == pytest.approx(3 + (2 - 3) / 3) and b[5] == pytest.approx(3 + (6 - 3) / 3)


def test_bollinger_sums_in_order_of_date(spark):
    """Mean and deviation to the last bit: sums in order, squares about the mean."""
    import datetime as dt
    import math
    import random

    from tickloom.operators.indicators import bollinger

    rng = random.Random(5)
    close = [round(rng.uniform(900, 2100), 2) / rng.randint(1, 50) for _ in range(300)]
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(300)]
    df = spark.createDataFrame([("X", "A", d, c) for d, c in zip(days, close)], "exchange string, symbol string, period_date date, close double")
    got = {r["period_date"]: r for r in bollinger(df).collect()}
    assert got[days[19]]["bb_mid"] is None
    for i in range(20, 300):
        total = apart = 0.0
        for x in close[i - 20 : i]:
            total += x
        m = total / 20
        for x in close[i - 20 : i]:
            apart += (x - m) * (x - m)
        s = math.sqrt(apart / 20)
        r = got[days[i]]
        assert (r["bb_low"], r["bb_mid"], r["bb_high"]) == (m - 2 * s, m, m + 2 * s)
