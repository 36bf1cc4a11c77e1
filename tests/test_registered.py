"""Queries registered over the whole job of their operators."""

from tests.oracle import DATA
from tidemill.operators import bootstrap, eda
from tidemill.plans import forecasting


def test_precision_of_all_horizons_by_1000_replicates(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(bootstrap, "bootstrap_precision", lambda df, keys, n, seed: asked.append((n, {r[0] for r in df.select("horizon").distinct().collect()})) or df)
    forecasting.e10_bootstrap_precision(spark, str(DATA))
    assert asked == [(1000, {5, 15, 60})]


def test_day_of_lags(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(eda, "pacf", lambda df, key, lags: asked.append(lags) or df)
    forecasting.d16_pacf(spark, str(DATA))
    assert asked == [288]
    most = forecasting.d15_acf_288(spark, str(DATA)).agg({"lag": "max"}).first()[0]
    assert most == 288
