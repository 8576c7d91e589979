"""Scores from 0 to 100: axes as ratios, weighted, rounded half to even as integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import clamp, grade, round_even

#: The weights of each kind's axes.
HLD = {"grounding": 25, "coverage": 20, "connectivity": 25, "abstraction": 15, "validity": 15}
CLASS = {"grounding": 35, "coverage": 20, "relationships": 20, "readability": 10, "validity": 15}
SEQUENCE = {"grounding": 30, "coverage": 20, "flow": 20, "readability": 10, "validity": 20}
COMPONENT = {"grounding": 25, "coverage": 20, "readability": 20, "abstraction": 15, "validity": 20}
DEPENDENCY = {"grounding": 30, "coverage": 30, "connectivity": 20, "validity": 20}


def compose(axes: dict[str, Column], weights: dict[str, int]) -> list[Column]:
    """Columns: each axis in points, the weighted score, its grade. Axes are clamped to 0..1 first."""
    points = {a: round_even(100 * clamp(x)) for a, x in axes.items()}
    total = sum((points[a] * w for a, w in weights.items()), F.lit(0)) / float(sum(weights.values()))
    score = round_even(total)
    return [*[points[a].alias(a) for a in weights], score.alias("score"), grade(score).alias("grade")]
