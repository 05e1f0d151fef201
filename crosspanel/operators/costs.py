"""Delivery-trade charges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import rnd

# Charge schedule.
BROKERAGE = 0.0
STT = 0.001
EXCHANGE = 0.0000297
SEBI = 0.000001
STAMP = 0.00015
GST = 0.18
DP_CHARGE = 13.0


def _leg(v: Column, stamp_rate: float, dp: float) -> Column:
    brokerage, stt, exch, sebi, stamp = BROKERAGE * v, STT * v, EXCHANGE * v, SEBI * v, stamp_rate * v
    gst = GST * (brokerage + exch + sebi)
    return F.struct(brokerage.alias("brokerage"), stt.alias("stt"), exch.alias("exchange"), sebi.alias("sebi"), stamp.alias("stamp"), gst.alias("gst"),
                    F.lit(dp).alias("dp_charge"), (brokerage + stt + exch + sebi + stamp + gst + dp).alias("total"))


def buy_charges(value: Column) -> Column:
    """Itemised charges of the buy leg (stamp duty, no depository charge)."""
    return _leg(value, STAMP, 0.0)


def sell_charges(value: Column) -> Column:
    """Itemised charges of the sell leg (flat depository charge, no stamp duty)."""
    return _leg(value, 0.0, DP_CHARGE)


def round_trip_cost(buy_value: Column, sell_value: Column) -> Column:
    return buy_charges(buy_value)["total"] + sell_charges(sell_value)["total"]


def cost_fraction(value: Column, slippage_bps: float = 10.0) -> Column:
    return (round_trip_cost(value, value) + 2 * slippage_bps / 1e4 * value) / (value + 1e-9)


def typical_cost_fraction(value: float = 100_000.0, slippage_bps: float = 10.0) -> float:
    """The same formula for one plain number: the default period cost of a portfolio."""
    rate = 2 * (BROKERAGE + STT + EXCHANGE + SEBI + GST * (BROKERAGE + EXCHANGE + SEBI)) + STAMP
    return (rate * value + DP_CHARGE + 2 * slippage_bps / 1e4 * value) / (value + 1e-9)


def buy_preview(price: Column, shares: Column, slippage_bps: float = 10.0) -> dict[str, Column]:
    """Fill with adverse slippage, charges, total debit and breakeven price of a buy."""
    fill = price * (1 + slippage_bps / 1e4)
    gross = fill * shares
    charges, exit_charges = buy_charges(gross)["total"], sell_charges(gross)["total"]
    return {"fill_price": rnd(fill, 2), "gross_cost": rnd(gross, 2), "charges": rnd(charges, 2), "total_debit": rnd(gross + charges, 2),
            "breakeven_price": rnd((gross + charges + exit_charges) / F.greatest(shares, F.lit(1)), 2), "slippage_amount": rnd((fill - price) * shares, 2)}


def sell_preview(price: Column, shares: Column, slippage_bps: float = 10.0) -> dict[str, Column]:
    fill = price * (1 - slippage_bps / 1e4)
    proceeds = fill * shares
    charges = sell_charges(proceeds)["total"]
    return {"fill_price": rnd(fill, 2), "proceeds": rnd(proceeds, 2), "charges": rnd(charges, 2), "net_credit": rnd(proceeds - charges, 2),
            "slippage_amount": rnd((price - fill) * shares, 2)}
