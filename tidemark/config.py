"""Scoring profile and other fixed values.

Anchors, weights, thresholds and label cuts must equal the published profile for
results to agree, so they are stated here as plain values.
"""

from __future__ import annotations

FIVE_POINT = (0.0, 25.0, 50.0, 75.0, 100.0)


def anchors(*xs: float) -> list[tuple[float, float]]:
    """Five x values paired with scores 0, 25, 50, 75, 100."""
    return list(zip(xs, FIVE_POINT, strict=True))


# --- fixed values: theme profile -------------------------------------------------
LOOKBACK_BARS = 380

STRENGTH = {
    "window": 63,
    "weights": {"risk_adjusted": 0.7, "consistency": 0.3},
    "risk_adjusted": anchors(-1.5, -0.5, 0.0, 0.5, 1.5),
    "consistency": anchors(0.35, 0.45, 0.50, 0.55, 0.65),
    "labels": [(75.0, "Strong"), (60.0, "Bull"), (45.0, "Neutral"), (30.0, "Bear"), (0.0, "Weak")],
    "min_ranked": 4,
    "min_thin": 2,
}

VELOCITY = {"level_ma": 63, "momentum": 21, "confirm": 5, "min_members": 2, "slack": 5}

HEAT = {
    "return_days": 10,
    "breadth_ma": 50,
    "breadth_change": 10,
    "history_days": 60,
    "signal_days": 3,
    "weight": 0.3333333333333333,
    "risk_adjusted": anchors(-1.5, -0.5, 0.0, 0.5, 1.5),
    "breadth": anchors(-0.5, -0.2, 0.0, 0.2, 0.5),
    "activity": anchors(-1.5, -0.5, 0.0, 1.0, 2.5),
    "hot": 75.0,
    "loo_min": 60.0,
    "max_share": 0.6,
    "min_members": 2,
    "hot_members": 3,
}

TURNING = {
    "history": 252,
    "window": 63,
    "percentile": 0.15,
    "drawdown": -0.25,
    "breadth_min": 0.0,
    "no_new_low": 5,
    "min_members": 2,
}

SELECTION = {
    "returns": 21,
    "correlation": 20,
    "min_returns": 80,
    "min_members": 4,
    "min_themes": 3,
    "high_dispersion": 0.04,
    "low_dispersion": 0.02,
    "high_max_correlation": 0.65,
    "low_min_correlation": 0.85,
}

MOMENTUM = {"lag": 15, "small": 3.0, "large": 8.0}

# --- fixed values: market regime ---------------------------------------------------
REGIME_LABELS = [
    (75.0, "Strong Bull"),
    (60.0, "Bull"),
    (45.0, "Neutral"),
    (30.0, "Bear"),
    (0.0, "Strong Bear"),
]
INSTABILITY_LABELS = [
    (85.0, "Stress"),
    (70.0, "Unstable"),
    (50.0, "Volatile"),
    (30.0, "Normal"),
    (0.0, "Stable"),
]
TREND = {
    "weights": {"vs200": 0.35, "ret63": 0.25, "ma50_200": 0.15, "breadth": 0.15, "credit": 0.10},
    "vs200": anchors(-0.12, -0.06, 0.0, 0.08, 0.16),
    "ret63": anchors(-0.18, -0.08, 0.0, 0.10, 0.22),
    "ma50_200": anchors(-0.06, -0.02, 0.0, 0.02, 0.06),
    "relative": anchors(-0.08, -0.03, 0.0, 0.03, 0.08),
}
SEMIS = {
    "weights": {"vs200": 0.30, "ret63": 0.25, "relative": 0.30, "ret21": 0.15},
    "vs200": anchors(-0.15, -0.07, 0.0, 0.10, 0.20),
    "ret63": anchors(-0.24, -0.10, 0.0, 0.12, 0.24),
    "relative": anchors(-0.10, -0.04, 0.0, 0.04, 0.10),
    "ret21": anchors(-0.12, -0.05, 0.0, 0.06, 0.12),
}
INSTABILITY = {
    "weights": {"vix": 0.40, "volatility": 0.35, "drawdown": 0.25},
    "vix": anchors(13.0, 16.0, 20.0, 28.0, 40.0),
    "volatility": anchors(0.10, 0.14, 0.18, 0.28, 0.40),
    "drawdown": anchors(0.0, 0.03, 0.06, 0.10, 0.16),
}
# (state, entry threshold held two sessions, exit threshold)
REGIME_RUNGS = {
    "strong_bull": (78.0, 68.0),
    "bull": (62.0, 52.0),
    "bear": (38.0, 48.0),
    "strong_bear": (22.0, 32.0),
}
STRESS = {"instability": 85.0, "vix": 32.0, "ret5": -0.06, "drawdown": 0.12, "clear_days": 3}

# --- fixed values: display, research, ledgers --------------------------------------
RETURN_SESSIONS = (1, 5, 21, 63)
RVOL_SESSIONS = 20
RVOL_ELEVATED = 1.0
RANK_OFFSETS = (0, 1, 3, 5)
HORIZONS = (5, 20, 60)
BASIS = ("data_source", "adjustment_type", "split_adjusted", "dividend_adjusted", "price_basis")
FX_STALE_DAYS = 4
SHRINK_FLOOR = 0.85
