import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Panel from `{unique_id: [values]}` on a regular grid; None is a missing row value."""
    def build(series, freq="h", start="2024-01-01 00:00:00", drop_missing=False):
        frames = []
        for uid, values in series.items():
            ds = pd.date_range(start, periods=len(values), freq=freq)
            frames.append(pd.DataFrame({"unique_id": uid, "ds": ds, "y": np.array(values, dtype=float)}))
        pdf = pd.concat(frames)
        if drop_missing:
            pdf = pdf[pdf["y"].notna()]
        rows = [(u, d.to_pydatetime(), None if np.isnan(y) else float(y)) for u, d, y in pdf.itertuples(index=False)]
        return spark.createDataFrame(rows, "unique_id string, ds timestamp, y double")
    return build


@pytest.fixture
def rng():
    return np.random.default_rng(11)
