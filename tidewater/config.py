"""Constants and date windows."""

from __future__ import annotations

from datetime import date, timedelta

VALIDATION_START = date(2020, 9, 16)
LOOKBACK_DAYS = 90
TARGET_DAYS = 7
TOP_K = 12
CANDIDATE_BUDGET = 300
NEGATIVES_PER_POSITIVE = 20
RRF_K = 60.0
ABSENT_RANK, ABSENT_SCORE = 9999, 0.0
DEFAULT_AGE = 30


def feature_window(as_of: date, days: int = LOOKBACK_DAYS) -> tuple[date, date]:
    """[start, as_of)."""
    return as_of - timedelta(days=days), as_of


def target_window(as_of: date, days: int = TARGET_DAYS) -> tuple[date, date]:
    return as_of, as_of + timedelta(days=days)


def last_week(as_of: date) -> date:
    return as_of - timedelta(days=7)
