import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from crosspanel.session import local_session

    return local_session(8, checkpoint_dir=str(tmp_path_factory.mktemp("stage")))


@pytest.fixture(scope="session")
def walk(spark):
    """Seeded random walk: 3 tickers x 1,300 days (more than two exponential blocks)."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    frames = []
    for t in (1, 2, 3):
        n = 1300
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        hi, lo = c * (1 + abs(rng.normal(0, 0.005, n))), c * (1 - abs(rng.normal(0, 0.005, n)))
        frames.append(pd.DataFrame({"ticker": t, "date": pd.date_range("2015-01-01", periods=n).date, "open": c, "high": hi, "low": lo, "close": c, "volume": rng.integers(1, 500, n).astype(float)}))
    pdf = pd.concat(frames, ignore_index=True)
    return pdf, spark.createDataFrame(pdf, "ticker long, date date, open double, high double, low double, close double, volume double").repartition(4).cache()
