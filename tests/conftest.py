import os
import sys
import warnings

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
warnings.filterwarnings("ignore")

from tidecast.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from tidecast.catalog.tables import Tables

    return Tables(spark, SF)


def months(n, start="2010-01-01"):
    return [d.date() for d in pd.date_range(start, periods=n, freq="MS")]


def long_panel(spark, x, names=None, entity="e", start="2010-01-01"):
    """Matrix (time x series, NaN missing) to a dense long panel."""
    x = np.asarray(x, float)
    names = names or [f"s{j:02d}" for j in range(x.shape[1])]
    at = months(len(x), start)
    rows = [
        (entity, names[j], at[t], None if np.isnan(x[t, j]) else float(x[t, j]))
        for t in range(x.shape[0]) for j in range(x.shape[1])
    ]
    return spark.createDataFrame(rows, "entity_id string, series_id string, period date, value double")


def values(df, series="s00"):
    rows = df.filter(df.series_id == series).orderBy("period").collect()
    return [r["value"] for r in rows]


def factor_data(n_t=120, n=12, r=2, gaps=0.1, seed=42):
    rng = np.random.default_rng(seed)
    f = np.zeros((n_t, r))
    for t in range(1, n_t):
        f[t] = np.array([0.7, 0.4, 0.5][:r]) * f[t - 1] + rng.normal(size=r) * 0.6
    lam = rng.normal(size=(n, r))
    x = f @ lam.T + rng.normal(size=(n_t, n)) * 0.5
    x[rng.random((n_t, n)) < gaps] = np.nan
    return x, f, lam
