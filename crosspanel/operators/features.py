"""Per-ticker features over the series window.

All of them share one partitioning (ticker) and one order (date), so Spark runs
the whole set after a single exchange and sort.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.numeric import EPS, flag, log_ratio, ratio
from ..functions.windows import ewm, lag, rolling, series

H, L, V = "high", "low", "volume"
CALENDAR = ("day_of_week", "day_of_month", "month", "is_expiry_week")
RANKED = ("ret_5d", "cum_ret_21d", "rsi_14", "atr_norm", "vol_z20", "dollar_vol_20d")
TICKER_FEATURES = (
    [f"ret_{n}d" for n in (1, 2, 3, 5, 10, 21)] + [f"cum_ret_{n}d" for n in (5, 10, 21, 63)]
    + [f"dist_sma{n}" for n in (5, 10, 20, 50, 200)] + [f"price_pos_{n}d" for n in (10, 21, 63)]
    + ["rsi_14", "stoch_k", "stoch_d", "macd", "macd_signal", "macd_hist", "bb_pctb", "bb_width", "atr_norm"]
    + [f"rvol_{n}d" for n in (10, 21, 63)]
    + ["park_vol_21", "vol_z20", "obv_z20", "vwap_dev", "volume_roc_5d", "volume_roc_21d", "dollar_vol_20d", "ret_vol_corr_21d", "weak_breakout_21d"]
    + list(CALENDAR)
)

Cols = dict[str, Column]


def with_columns(df: DataFrame, cols: Cols) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in cols.items()])


def add_rolling(df: DataFrame, specs: dict[str, tuple], cols, drop: tuple[str, ...] = ()) -> DataFrame:
    """Rolling helpers, the columns computed from them, then drop the helpers."""
    return with_columns(rolling(df, specs), cols()).drop(*specs, *drop)


# --- returns ---------------------------------------------------------------
def log_returns(ns=(1, 2, 3, 5, 10, 21), price: str = "close") -> Cols:
    return {f"ret_{n}d": log_ratio(price, lag(price, n)) for n in ns}


def cumulative_returns(ns=(5, 10, 21, 63), price: str = "close", prefix: str = "cum_ret_", suffix: str = "d") -> Cols:
    return {f"{prefix}{n}{suffix}": ratio(price, lag(price, n)) - 1.0 for n in ns}


# Each group below is (rolling specs, columns from them); the builder merges the
# specs of all groups into one rolling pass.
def sma_specs(ns=(5, 10, 20, 50, 200), price: str = "close") -> dict[str, tuple]:
    return {f"_sma{n}": ("avg", price, n) for n in ns}


def sma_columns(ns=(5, 10, 20, 50, 200), price: str = "close", eps: float = EPS) -> Cols:
    return {f"dist_sma{n}": ratio(price, F.col(f"_sma{n}") + eps) - 1.0 for n in ns}


def sma_distance(df: DataFrame, ns=(5, 10, 20, 50, 200), eps: float = EPS) -> DataFrame:
    return add_rolling(df, sma_specs(ns), lambda: sma_columns(ns, eps=eps))


def range_specs(ns=(10, 21, 63), price: str = "close") -> dict[str, tuple]:
    return {f"_{f}{n}": (f, price, n) for n in ns for f in ("min", "max")}


def range_columns(ns=(10, 21, 63), price: str = "close") -> Cols:
    return {f"price_pos_{n}d": ratio(F.col(price) - F.col(f"_min{n}"), F.col(f"_max{n}") - F.col(f"_min{n}") + EPS) for n in ns}


def range_position(df: DataFrame, ns=(10, 21, 63)) -> DataFrame:
    return add_rolling(df, range_specs(ns), lambda: range_columns(ns))


def stochastic_specs(k: int = 14) -> dict[str, tuple]:
    return {"_lo": ("min", L, k), "_hi": ("max", H, k)}


def stochastic_columns() -> Cols:
    return {"stoch_k": 100.0 * ratio(F.col("close") - F.col("_lo"), F.col("_hi") - F.col("_lo") + EPS)}


def stochastic(df: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    return rolling(add_rolling(df, stochastic_specs(k), stochastic_columns), {"stoch_d": ("avg", "stoch_k", d)})


def bollinger_specs(n: int = 20, price: str = "close") -> dict[str, tuple]:
    return {"_mid": ("mean", price, n), "_sd": ("std", price, n)}


def bollinger_columns(price: str = "close") -> Cols:
    up, dn = F.col("_mid") + 2 * F.col("_sd"), F.col("_mid") - 2 * F.col("_sd")
    return {"bb_pctb": ratio(F.col(price) - dn, up - dn + EPS), "bb_width": ratio(up - dn, F.col("_mid") + EPS)}


def bollinger(df: DataFrame, n: int = 20) -> DataFrame:
    return add_rolling(df, bollinger_specs(n), bollinger_columns)


# --- oscillators -----------------------------------------------------------
def true_range() -> Column:
    """Row 1 has no previous close: its range is high - low."""
    prev = lag("close")
    return F.greatest(F.col(H) - F.col(L), F.abs(F.col(H) - prev), F.abs(F.col(L) - prev))


def rsi_from(up: Column, dn: Column) -> Column:
    return 100.0 - ratio(F.lit(100.0), 1.0 + ratio(up, dn + EPS))


def moves() -> Cols:
    d = F.col("close") - lag("close")
    return {"_up": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "_dn": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))}


def rsi_wilder(df: DataFrame, n: int = 14) -> DataFrame:
    df = ewm(with_columns(df, moves()), {"_eu": ("_up", 1 / n), "_ed": ("_dn", 1 / n)})
    return with_columns(df, {f"rsi_{n}": rsi_from(F.col("_eu"), F.col("_ed"))}).drop("_up", "_dn", "_eu", "_ed")


def rsi_simple(df: DataFrame, n: int = 14) -> DataFrame:
    specs = {"_au": ("avg", "_up", n), "_ad": ("avg", "_dn", n)}
    return add_rolling(with_columns(df, moves()), specs, lambda: {f"rsi_{n}": rsi_from(F.col("_au"), F.col("_ad"))}, ("_up", "_dn"))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ewm(df, {"_ef": ("close", 2 / (fast + 1)), "_es": ("close", 2 / (slow + 1))}).withColumn("macd", F.col("_ef") - F.col("_es"))
    df = ewm(df, {"macd_signal": ("macd", 2 / (signal + 1))})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_ef", "_es")


def atr_wilder(df: DataFrame, n: int = 14) -> DataFrame:
    df = ewm(df.withColumn("_tr", true_range()), {"_atr": ("_tr", 1 / n)})
    return df.withColumn("atr_norm", ratio("_atr", F.col("close") + EPS)).drop("_tr", "_atr")


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """Average directional index with Wilder smoothing (published definition)."""
    up, dn = F.col(H) - lag(H), lag(L) - F.col(L)
    df = with_columns(df, {
        "_tr": F.when(lag("close").isNotNull(), true_range()),
        "_pdm": F.when(up.isNotNull(), F.when((up > dn) & (up > 0), up).otherwise(0.0)),
        "_ndm": F.when(dn.isNotNull(), F.when((dn > up) & (dn > 0), dn).otherwise(0.0))})
    df = ewm(df, {"_etr": ("_tr", 1 / n), "_ep": ("_pdm", 1 / n), "_en": ("_ndm", 1 / n)})
    pdi, ndi = 100.0 * ratio("_ep", "_etr"), 100.0 * ratio("_en", "_etr")
    df = df.withColumn("_dx", F.when(F.col("_etr").isNotNull(), F.coalesce(100.0 * ratio(F.abs(pdi - ndi), pdi + ndi), F.lit(0.0))))
    return ewm(df, {"adx": ("_dx", 1 / n)}).drop("_tr", "_pdm", "_ndm", "_etr", "_ep", "_en", "_dx")


# --- volatility and volume -------------------------------------------------
def realised_vol(df: DataFrame, ns=(10, 21, 63), ret: str = "ret_1d") -> DataFrame:
    return rolling(df, {f"rvol_{n}d": ("std", ret, n) for n in ns})


def parkinson_term() -> Column:
    return F.pow(log_ratio(H, L), 2.0) / (4.0 * math.log(2.0))


def parkinson_vol(df: DataFrame, n: int = 21) -> DataFrame:
    return add_rolling(df.withColumn("_pk", parkinson_term()), {"_pkm": ("avg", "_pk", n)}, lambda: {f"park_vol_{n}": F.sqrt("_pkm")}, ("_pk",))


def zscore_specs(x: str, n: int, tag: str) -> dict[str, tuple]:
    return {f"_{tag}m": ("mean", x, n), f"_{tag}s": ("std", x, n)}


def zscore_column(x: str, tag: str) -> Column:
    return ratio(F.col(x) - F.col(f"_{tag}m"), F.col(f"_{tag}s") + EPS)


def volume_zscore(df: DataFrame, n: int = 20) -> DataFrame:
    return add_rolling(df, zscore_specs(V, n, "v"), lambda: {f"vol_z{n}": zscore_column(V, "v")})


def obv(df: DataFrame) -> DataFrame:
    df = df.withColumn("_sv", F.signum(F.col("close") - lag("close")) * F.col(V))
    return df.withColumn("obv", F.sum("_sv").over(series().rowsBetween(W.unboundedPreceding, 0))).drop("_sv")


def obv_zscore(df: DataFrame, n: int = 20) -> DataFrame:
    return add_rolling(obv(df), zscore_specs("obv", n, "o"), lambda: {f"obv_z{n}": zscore_column("obv", "o")}, ("obv",))


def traded_terms() -> Cols:
    typical = (F.col("open") + F.col(H) + F.col(L) + F.col("close")) / 4.0
    return {"_tpv": typical * F.col(V), "_cv": F.col("close") * F.col(V)}


def vwap_specs(n: int = 20) -> dict[str, tuple]:
    return {"_stpv": ("sum", "_tpv", n), "_sv20": ("sum", V, n)}


def vwap_columns() -> Cols:
    return {"vwap_dev": ratio("close", ratio("_stpv", F.col("_sv20") + EPS) + EPS) - 1.0}


def vwap_deviation(df: DataFrame, n: int = 20) -> DataFrame:
    return add_rolling(with_columns(df, traded_terms()), vwap_specs(n), vwap_columns, ("_tpv", "_cv"))


def volume_roc(ns=(5, 21)) -> Cols:
    return {f"volume_roc_{n}d": log_ratio(F.col(V) + 1.0, lag(V, n) + 1.0) for n in ns}


def dollar_volume(df: DataFrame, n: int = 20) -> DataFrame:
    return add_rolling(with_columns(df, traded_terms()), {"_mcv": ("avg", "_cv", n)}, lambda: {f"dollar_vol_{n}d": F.log1p("_mcv")}, ("_tpv", "_cv"))


def return_volume_corr(df: DataFrame, n: int = 21, ret: str = "ret_1d", vz: str = "vol_z20") -> DataFrame:
    return rolling(df, {f"ret_vol_corr_{n}d": ("corr", ret, vz, n)})


def weak_breakout_column(n: int = 21) -> Cols:
    return {f"weak_breakout_{n}d": flag((F.col("close") >= F.col(f"_max{n}")) & (F.col(V) < F.col("_vm")))}


def weak_breakout(df: DataFrame, n: int = 21, m: int = 20) -> DataFrame:
    return add_rolling(df, {f"_max{n}": ("max", "close", n), "_vm": ("mean", V, m)}, lambda: weak_breakout_column(n))


def calendar_features(day: str = "date") -> Cols:
    dow, dom = F.weekday(day), F.dayofmonth(day)
    return {"day_of_week": dow, "day_of_month": dom, "month": F.month(day), "is_expiry_week": flag((dow == 3) & (dom >= 24))}


# --- builders --------------------------------------------------------------
def simple_return_features(df: DataFrame) -> DataFrame:
    """Lean price-only set: ret_5/10/21/63, vol_21, rsi_14 (simple mean), dist_sma20/50."""
    df = with_columns(df, {**cumulative_returns(prefix="ret_", suffix=""), "_r1": ratio("close", lag("close")) - 1.0, **moves()})
    specs = {**sma_specs((20, 50)), "vol_21": ("std", "_r1", 21), "_au": ("avg", "_up", 14), "_ad": ("avg", "_dn", 14)}
    df = with_columns(rolling(df, specs), {**sma_columns((20, 50), eps=0.0), "rsi_14": rsi_from(F.col("_au"), F.col("_ad"))})
    return df.drop("_r1", "_up", "_dn", "_au", "_ad", "_sma20", "_sma50")


def _series_inputs(bars: DataFrame) -> DataFrame:
    """The bars with features that only need lags, and the columns that rolling and exponential means read."""
    df = with_columns(bars, {**log_returns(), **cumulative_returns(), **volume_roc(), **calendar_features(), **moves(), **traded_terms(),
                             "_tr": true_range(), "_pk": parkinson_term(), "_sv": F.signum(F.col("close") - lag("close")) * F.col(V)})
    return df.withColumn("_obv", F.sum("_sv").over(series().rowsBetween(W.unboundedPreceding, 0)))


def _series_specs() -> dict[str, tuple]:
    return {**sma_specs(), **range_specs(), **stochastic_specs(), **bollinger_specs(), **zscore_specs(V, 20, "v"), **zscore_specs("_obv", 20, "o"),
            **vwap_specs(), "_mcv": ("avg", "_cv", 20), "_pkm": ("avg", "_pk", 21), **{f"rvol_{n}d": ("std", "ret_1d", n) for n in (10, 21, 63)}}


def _series_columns() -> Cols:
    return {**sma_columns(), **range_columns(), **stochastic_columns(), **bollinger_columns(), "vol_z20": zscore_column(V, "v"), "obv_z20": zscore_column("_obv", "o"),
            **vwap_columns(), "dollar_vol_20d": F.log1p("_mcv"), "park_vol_21": F.sqrt("_pkm"), **weak_breakout_column()}


_MEANS = {"_eu": ("_up", 1 / 14), "_ed": ("_dn", 1 / 14), "_atr": ("_tr", 1 / 14), "_ef": ("close", 2 / 13), "_es": ("close", 2 / 27)}
_SIGNAL = {"macd_signal": ("macd", 2 / 10)}
_LAST = {"stoch_d": ("avg", "stoch_k", 3), "ret_vol_corr_21d": ("corr", "ret_1d", "vol_z20", 21)}


def _oscillators() -> Cols:
    return {"macd_hist": F.col("macd") - F.col("macd_signal"), "rsi_14": rsi_from(F.col("_eu"), F.col("_ed")), "atr_norm": ratio("_atr", F.col("close") + EPS)}


def ticker_features(bars: DataFrame, in_arrays: bool = False, more: dict[str, tuple] | None = None, market: DataFrame | None = None) -> DataFrame:
    """All per-ticker features over one exchange and one sort.

    Lag columns first, then one shared rolling pass, the exponential means, and a
    last rolling pass for the two features that need a rolling feature as input.
    With `in_arrays` the passes run in one task step over arrays (`functions.arrays`);
    `more` rolling columns, which may read columns by date of `market`, then go along.
    """
    df = _series_inputs(bars)
    if in_arrays:
        return _features_in_arrays(bars, df, more or {}, market)
    df = with_columns(rolling(df, _series_specs()), _series_columns())
    done = [c for c in TICKER_FEATURES if c in df.columns]
    df = df.select(*bars.columns, *done, "_up", "_dn", "_tr")
    df = ewm(df, _MEANS)
    df = df.withColumn("macd", F.col("_ef") - F.col("_es"))
    df = with_columns(ewm(df, _SIGNAL), _oscillators())
    return rolling(df, _LAST).select(*bars.columns, *TICKER_FEATURES)


def _stochastic_and_volume(cols: dict, at) -> dict:
    """stoch_k and vol_z20 as in `stochastic_columns` and `zscore_column`, for the last rolling pass."""
    out = {}
    for name, x, a, b, scale in (("stoch_k", "close", "_lo", None, 100.0), ("vol_z20", V, "_vm", "_vs", 1.0)):
        under = cols["_hi"][0] - cols["_lo"][0] if b is None else cols[b][0]
        value, defined = arrays.divide(cols[x][0] - cols[a][0], under + EPS)
        out[name] = (scale * value, defined & cols[x][1] & cols[a][1] & cols[b or "_hi"][1])
    return out


def _macd(cols: dict, at) -> dict:
    return {"macd": (cols["_ef"][0] - cols["_es"][0], cols["_ef"][1] & cols["_es"][1])}


def _features_in_arrays(bars: DataFrame, df: DataFrame, more: dict[str, tuple], market: DataFrame | None) -> DataFrame:
    specs, last = _series_specs(), {**_LAST, **more}
    if market is not None:
        df = df.join(F.broadcast(market), "date", "left")
    steps = [partial(arrays.rolling, specs=specs), _stochastic_and_volume, partial(arrays.ewm, specs=_MEANS), _macd, partial(arrays.ewm, specs=_SIGNAL), partial(arrays.rolling, specs=last)]
    reads = dict.fromkeys([c for s in (*specs.values(), *last.values()) for c in s[1:-1]] + [x for x, _ in _MEANS.values()])
    reads = [c for c in reads if c in df.columns]
    keep = [*bars.columns, *[c for c in TICKER_FEATURES if c in df.columns], "_obv"]
    outs = [*specs, "_eu", "_ed", "_atr", "macd", *_SIGNAL, *last]
    df = arrays.series_pass(df, reads, steps, keep, outs)
    df = with_columns(df, {**_series_columns(), **_oscillators()})
    return df.select(*bars.columns, *TICKER_FEATURES, *more)
