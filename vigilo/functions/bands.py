"""Score → band / action / route, and the cascade combiners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three band tables (lower bounds, inclusive, high → low).
BANDS_INFERENCE = [(0.02, "High Risk"), (0.005, "Review Needed")], "Low Risk"
BANDS_STREAM = [(0.02, "High"), (0.005, "Review")], "Low"
BANDS_DASHBOARD = [(0.08, "High"), (0.04, "Review"), (0.01, "Medium")], "Low"
ROUTES = [(0.80, "AUTO_BLOCKED"), (0.02, "REVIEW_QUEUED")], "PASSED"
# Recommended action per dashboard band.
ACTIONS = {"High": "Escalate", "Review": "Manual review", "Medium": "Monitor", "Low": "No action"}


def band(score: Column, table) -> Column:
    cuts, default = table
    e = F.lit(default)
    for lo, name in reversed(cuts):
        e = F.when(score >= lo, F.lit(name)).otherwise(e)
    return e


def action(band_col: Column) -> Column:
    e = F.lit(None).cast("string")
    for b, a in ACTIONS.items():
        e = F.when(band_col == b, F.lit(a)).otherwise(e)
    return e


def band_percentile(score: Column, p999: Column, p99: Column, p95: Column) -> Column:
    return (F.when(score >= p999, "High").when(score >= p99, "Review")
             .when(score >= p95, "Medium").otherwise("Low"))


def cascade_ab(missing: Column, hard_score: Column, floor: float = 1e-6) -> Column:
    """Missing time-since-last → ``floor``, else the hard-subset score."""
    return F.when(missing == 1, F.lit(floor)).otherwise(hard_score)


def cascade_c(missing: Column, base: Column, hard: Column, cap: float = 1e-3) -> Column:
    return F.when(missing == 1, F.least(base, F.lit(cap))).otherwise(hard)


def cascade_d(base: Column, second: Column, p80: Column) -> Column:
    """Top 20 % of the base score re-scored by the second model, rest − 1."""
    return F.when(base >= p80, second).otherwise(base - 1.0)
