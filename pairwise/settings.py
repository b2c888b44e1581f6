"""Constants shared by the operators. No environment is read here."""

from __future__ import annotations

# --- fixed values: vocabularies -------------------------------------------------
SURFACES = ["Hard", "Clay", "Grass", "Carpet"]
ANY_SURFACE = SURFACES + ["Unknown"]

LEVEL_WEIGHTS = {
    "G": 1.00, "M": 0.95, "A": 0.90, "F": 1.00, "O": 0.85,
    "D": 0.80, "C": 0.70, "S": 0.60, "Q": 0.70,
}
DEFAULT_LEVEL_WEIGHT = 0.8

ROUNDS = {
    "Q1": 0, "Q2": 1, "Q3": 2, "Q4": 3, "ER": 4, "BR": 5, "RR": 6,
    "R128": 7, "R64": 8, "R32": 9, "R16": 10, "QF": 11, "SF": 12, "F": 13,
}
DEFAULT_ROUND = 7

# --- fixed values: ratings ------------------------------------------------------
START_RATING = 1500.0
K_SCALE, K_SHIFT, K_DECAY = 250.0, 5.0, 0.4
SURFACE_K = 1.15
SURFACE_BLEND = {"Hard": 0.55, "Clay": 0.68, "Grass": 0.70, "Carpet": 0.60}
DEFAULT_BLEND = 0.6
BLEND_PRIOR = 12.0
MARGIN_LOW, MARGIN_HIGH = 0.75, 1.35
IDLE_GRACE_DAYS = 90
IDLE_SHRINK_PER_YEAR, IDLE_SHRINK_CAP = 0.28, 0.45
RETIREMENT_WEIGHT = 0.55
SHARE_STRETCH, SHARE_LOW, SHARE_HIGH = 2.6, 0.02, 0.98

# --- fixed values: opponent-adjusted skill --------------------------------------
WINDOW_DAYS = 1095
REFIT_DAYS = 28
SKILL_HALF_LIFE = 365.0
RIDGE, SURFACE_RIDGE = 200.0, 550.0
NEUTRAL_RATE = 0.62

# --- fixed values: rolling history ----------------------------------------------
FORM_HALF_LIFE = 120.0
FORM_WINDOWS = [10, 25, 50]
RESULT_QUEUE, WORK_QUEUE, SURFACE_QUEUE, RETIRE_QUEUE = 120, 60, 40, 10
WORK_DAYS = [7, 14, 28]
BEST_REST_DAYS = 5.0
RETURN_AFTER_DAYS = 120
RETIRE_DAYS, SURFACE_DAYS = 90, 60
HEAD_TO_HEAD_PRIOR = 6.0
SURFACE_PRIOR = 8.0
BREAK_PRIOR, TIEBREAK_PRIOR, DECIDER_PRIOR = 60.0, 25.0, 12.0
# tour: (break points saved, break points converted)
BREAK_RATES = {"atp": (0.615, 0.405), "wta": (0.565, 0.455)}

# --- fixed values: model --------------------------------------------------------
HOLDOUT = 0.18
MIN_HOLDOUT_ROWS = 200
ISOTONIC_MIN_ROWS = 4000
TREE_ROUNDS, TREE_STEP, TREE_DEPTH, TREE_MIN_LEAF = 400, 0.045, 6, 60
TREE_VALIDATION = 0.12
SEED = 7
