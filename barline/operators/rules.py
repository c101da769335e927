"""The catalogue of rule signals: for each a mask, a direction, a strength and a holding period in rows.

Masks, directions and strengths are SQL expressions over a panel and its derived columns. Adding a signal is adding a
Rule. Shapes that need whole windows (`shapes.py`) and the learned family (`learned.py`) make the same columns.
"""

from __future__ import annotations

from typing import NamedTuple

from ..functions.fragments import clip, div, no, yes


class Rule(NamedTuple):
    family: str
    signal: str
    mask: str
    direction: str
    strength: str
    horizon: int


RULES: list[Rule] = []


def _add(family: str, signal: str, mask: str, direction: int | str, strength: str, horizon: int) -> None:
    RULES.append(Rule(family, signal, mask, str(direction), strength, horizon))


# gaps: with news they go on, without they fade
_SIZES = (("small", 0.005, 0.015), ("mid", 0.015, 0.03), ("large", 0.03, 0.07), ("huge", 0.07, None))
for _way, _sign in (("up", 1), ("dn", -1)):
    _size_of = "gap" if _sign > 0 else "-gap"
    for _size, _low, _high in _SIZES:
        _inside = f"{_size_of} >= {_low}" + (f" AND {_size_of} < {_high}" if _high else "")
        for _news, _has in (("news", "coalesce(catalyst, 0) <> 0"), ("nonews", "coalesce(catalyst, 0) = 0")):
            _d = _sign if _news == "news" else -_sign
            _add("gaps", f"gap_{_way}_{_size}_{_news}", f"{_inside} AND {_has}", _d, "abs(gap)", 2)
            if _news == "news":
                _add("gaps", f"gap_{_way}_{_size}_news_hotvol", f"{_inside} AND {_has} AND rvol >= 2.0", _d, "abs(gap)", 2)

# anchors
_add("anchors", "near_52wk_high", "prox >= 0.98 AND prox <= 1.0", 1, "prox", 20)
_add("anchors", "far_52wk_high", "range_place <= 0.2", -1, "1 - range_place", 20)
_add("anchors", "fresh_52wk_breakout", "above52 AND coalesce(above52_60, 0) = 0", 1, "prox - 1", 10)

# breakouts
for _way, _beyond, _d in (("up", "close > or30_high", 1), ("dn", "close < or30_low", -1)):
    _add("breakouts", f"orb_30min_{_way}", f"{_beyond} AND abs(gap) < 0.005 AND or_range < or_median", _d, f"1 / ({clip('or_range', 0.1)})", 1)
for _n in (20, 55):
    _fresh = {d: f"beyond{_n}_{d} AND {no(f'beyond{_n}_{d}_1')}" for d in ("up", "dn")}
    _stretch = div(f"close - top{_n}", "atr")
    _add("breakouts", f"donchian{_n}_up", _fresh["up"], 1, _stretch, 10)
    _add("breakouts", f"donchian{_n}_dn", _fresh["dn"], -1, div(f"bottom{_n} - close", "atr"), 10)
    _add("breakouts", f"donchian{_n}_up_hotvol", f"{_fresh['up']} AND rvol > 1.5", 1, _stretch, 10)
_add("breakouts", "vcp_breakout", "contracting1 AND quiet5_1 < 0.8 AND close > hi15 AND rvol > 1.5", 1, clip(f"(1 - {div('range5', 'range5_10')})", 0.0, 1.0), 10)

# volume
_add("volume", "high_volume_premium", "rvol > 3.0 AND abs(ret) < 0.01", 1, "rvol", 10)
_place = "(close - low) / span"
_add("volume", "rvol_spike_up", f"rvol > 2.5 AND {_place} > 0.8 AND ret > 0.01", 1, "rvol", 5)
_add("volume", "rvol_spike_dn", f"rvol > 2.5 AND {_place} < 0.2 AND ret < -0.01", -1, "rvol", 5)
_add("volume", "accumulation_divergence", "close - c20 < 0 AND ad_z > 1.0", 1, "ad_z", 10)
_add("volume", "distribution_divergence", "close - c20 > 0 AND ad_z < -1.0", -1, "-ad_z", 10)
_add("volume", "obv_confirmed_breakout", "close > top20 AND obv > obv20", 1, "rvol", 10)

# trend
for _fast, _slow in ((5, 20), (20, 50), (50, 200)):
    _over, _spread = f"over{_fast}_{_slow}", f"abs({div(f'ma{_fast} - ma{_slow}', f'ma{_slow}')})"
    _add("trend", f"ma_cross_{_fast}_{_slow}_up", f"{_over} AND NOT coalesce({_over}_1, false)", 1, _spread, 20)
    # before the first row the fast average counts as above, so a ticker's first row is a cross down of strength 0
    _add("trend", f"ma_cross_{_fast}_{_slow}_dn", f"NOT {_over} AND coalesce({_over}_1, true)", -1, _spread, 20)
_add("trend", "tsmom_12_1_up", "ret252 - ret21 > 0.10", 1, "ret252 - ret21", 20)
_add("trend", "tsmom_12_1_dn", "ret252 - ret21 < -0.10", -1, "ret21 - ret252", 20)
_add("trend", "xs_momentum_winner", "mom_rank >= 0.9 AND month_start", 1, "mom_rank", 21)
_add("trend", "xs_momentum_loser", "mom_rank <= 0.1 AND month_start", -1, "1 - mom_rank", 21)
_add("trend", "bollinger_breakout_up", "close > band_up AND c1 <= band_up1", 1, div("close - band_up", "sd20"), 5)
_add("trend", "bollinger_revert_long", "close < band_dn AND rvol < 1.5", 1, div("band_dn - close", "sd20"), 5)
_add("trend", "keltner_breakout_up", "close > kup AND c1 <= kup1", 1, div("close - kup", "atr"), 10)

# fundamentals
_add("fundamentals", "quality_long", "quality_rank >= 0.9 AND month_start", 1, "quality_rank", 21)
_add("fundamentals", "quality_short", "quality_rank <= 0.1 AND month_start", -1, "1 - quality_rank", 21)
_add("fundamentals", "quality_breakout", f"beyond20_up AND {no('beyond20_up_1')} AND quality_rank >= 0.8", 1, "quality_rank", 10)

# candles, all held 3 rows with the body in ATRs as strength
for _name, _mask, _d in (
    ("hammer", "falling AND dn_shadow >= 2 * body AND up_shadow <= 0.1 * span AND body > 0.05 * span", 1),
    ("shooting_star", "rising AND up_shadow >= 2 * body AND dn_shadow <= 0.1 * span AND body > 0.05 * span", -1),
    ("bull_marubozu", "close > open AND body >= 0.95 * span AND body > 0.8 * atr", 1),
    ("bear_marubozu", "close < open AND body >= 0.95 * span AND body > 0.8 * atr", -1),
    ("bull_engulf", "falling AND c1 < o1 AND close > open AND open <= c1 AND close >= o1 AND body > body1", 1),
    ("bear_engulf", "rising AND c1 > o1 AND close < open AND open >= c1 AND close <= o1 AND body > body1", -1),
    ("bull_harami", "falling AND c1 < o1 AND close > open AND close <= o1 AND open >= c1", 1),
    ("bear_harami", "rising AND c1 > o1 AND greatest(open, close) <= c1 AND least(open, close) >= o1 AND close < open", -1),
    ("piercing", "falling AND c1 < o1 AND open < l1 AND close > 0.5 * (o1 + c1) AND close < o1", 1),
    ("dark_cloud", "rising AND c1 > o1 AND open > h1 AND close < 0.5 * (o1 + c1) AND close > o1", -1),
    ("morning_star", "falling2 AND c2 < o2 AND body1 < 0.3 * body2 AND close > open AND close > 0.5 * (o2 + c2)", 1),
    ("evening_star", "rising2 AND c2 > o2 AND body1 < 0.3 * body2 AND close < open AND close < 0.5 * (o2 + c2)", -1),
    ("three_white_soldiers", f"stout_up AND {yes('stout_up_1')} AND {yes('stout_up_2')} AND close > c1 AND c1 > c2", 1),
    ("three_black_crows", f"stout_dn AND {yes('stout_dn_1')} AND {yes('stout_dn_2')} AND close < c1 AND c1 < c2", -1),
):
    _add("candles", _name, _mask, _d, div("body", "atr"), 3)

# levels
_add("levels", "bounce_resistance", "high >= swing_hi - 0.25 * atr AND close < swing_hi AND swing_hi > 0", -1, f"5 - ({clip(div('swing_hi - close', 'atr'), 0, 5)})", 3)
_add("levels", "break_resistance", "close > swing_hi + 0.25 * atr AND c1 <= swing_hi1", 1, div("close - swing_hi", "atr"), 5)
_add("levels", "bounce_support", "low <= swing_lo + 0.25 * atr AND close > swing_lo", 1, f"5 - ({clip(div('close - swing_lo', 'atr'), 0, 5)})", 3)
_add("levels", "break_support", "close < swing_lo - 0.25 * atr AND c1 >= swing_lo1", -1, div("swing_lo - close", "atr"), 5)
_add("levels", "round_number_above", "abs(close - round_level) <= 0.15 * atr AND close > round_level", 1, "1.0", 3)
_add("levels", "round_number_below", f"abs(close - round_level) <= 0.15 * atr AND {no('close > round_level')}", -1, "1.0", 3)
_add("levels", "avwap_reclaim", "close > avwap AND c1 <= avwap1 AND anchor_id > 0", 1, div("close - avwap", "atr"), 5)
_add("levels", "avwap_loss", "close < avwap AND c1 >= avwap1 AND anchor_id > 0", -1, div("avwap - close", "atr"), 5)
for _n in (20, 50, 200):
    _add("levels", f"ma{_n}_bounce", f"above{_n} AND low <= ma{_n} AND c1 > ma{_n}_1", 1, div(f"close - ma{_n}", "atr"), 5)
    _add("levels", f"ma{_n}_loss", f"NOT above{_n} AND coalesce(above{_n}_1, false)", -1, div(f"ma{_n} - close", "atr"), 5)

# novel
_add("novel", "tpi_pullback_long", "purity > 0.75 AND trend20 > 0 AND close < c1 AND c1 < c2", 1, "purity", 5)
_add("novel", "tpi_rally_short", "purity > 0.75 AND trend20 < 0 AND close > c1 AND c1 > c2", -1, "purity", 5)
_expanding = "cer >= cer_q20 AND squeezed5 = 1 AND body > 0.6 * span"
_add("novel", "cer_expansion_long", f"{_expanding} AND close > open", 1, f"1 / ({clip('cer', 0.05)})", 5)
_add("novel", "cer_expansion_short", f"{_expanding} AND close < open", -1, f"1 / ({clip('cer', 0.05)})", 5)
_add("novel", "amo_reclaim_long", "memory > 0 AND memory1 <= 0 AND anchor_den > 0.5", 1, "memory", 5)
_add("novel", "amo_stretch_short", "memory > 4 AND anchor_den > 0.5", -1, "memory", 5)
_add("novel", "spi_dipbuy_long", "shadow_index < -0.25 AND above50", 1, "-shadow_index", 5)
_add("novel", "spi_rejection_short", "shadow_index > 0.25 AND NOT above50", -1, "shadow_index", 5)
_add("novel", "liquidity_vacuum_fade", "(high - low) > 1.5 * atr AND rvol < 0.7 AND close <> open", "-sign(close - open)", div("high - low", "atr"), 3)
_kept = " AND ".join(f"({x} - c3) * sign(gap2) >= 0.5 * (o2 - c3) * sign(gap2)" for x in ("c2", "c1", "close"))
_add("novel", "gap_echo_continuation", f"{_kept} AND abs(gap2) >= 0.03 AND coalesce(cat2, 0) <> 0", "sign(gap2)", "abs(gap2)", 10)

# flags of the shape family; the other shapes are in shapes.py
for _name, _mask, _d in (("bull_flag", "pole > 0.12 AND close > flag_hi", 1), ("bear_flag", "pole < -0.12 AND close < flag_lo", -1)):
    _add("lmw", _name, f"{_mask} AND {div('flag_hi - flag_lo', 'close')} < 0.4 * abs(pole)", _d, "abs(pole)", 10)

FAMILIES = ("lmw", "candles", "levels", "anchors", "breakouts", "gaps", "volume", "trend", "fundamentals", "novel", "ml")


def rules(*names: str) -> list[Rule]:
    """The rules of the given families or signals; all without any."""
    return [r for r in RULES if not names or r.family in names or r.signal in names]
