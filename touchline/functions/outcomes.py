"""Column expressions for ordered home/draw/away outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcome order, points per result, log-loss clip.
OUTCOMES = ("H", "D", "A")
POINTS = {"win": 3, "draw": 1, "loss": 0}
LOG_LOSS_CLIP = 1e-15

ColumnOrName = Column | str


def _c(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def outcome(home_goals: ColumnOrName, away_goals: ColumnOrName) -> Column:
    h, a = _c(home_goals), _c(away_goals)
    return F.when(h > a, "H").when(h == a, "D").when(h < a, "A")


def points(goals_for: ColumnOrName, goals_against: ColumnOrName) -> Column:
    f, a = _c(goals_for), _c(goals_against)
    return (
        F.when(f > a, POINTS["win"]).when(f == a, POINTS["draw"]).when(f < a, POINTS["loss"])
    ).cast("long")


def devig(odds_h: ColumnOrName, odds_d: ColumnOrName, odds_a: ColumnOrName) -> dict[str, Column]:
    """Implied probabilities normalised to sum to 1; null if any odd is missing or <= 1."""
    odds = [_c(odds_h), _c(odds_d), _c(odds_a)]
    usable = (odds[0] > 1) & (odds[1] > 1) & (odds[2] > 1)
    total = 1 / odds[0] + 1 / odds[1] + 1 / odds[2]
    return {
        name: F.when(usable, (1 / odd) / total)
        for name, odd in zip(("p_h", "p_d", "p_a"), odds, strict=True)
    }


def decay(ts: ColumnOrName, cutoff: ColumnOrName, xi: float) -> Column:
    """Weight of a match before the cutoff; null at or after it, where it must not count."""
    when, at = _c(cutoff), _c(ts)
    return F.when(at < when, F.exp(-F.lit(xi) * F.datediff(when, at)))


def prob_of(actual: ColumnOrName) -> Column:
    """The probability that was given to the outcome that happened."""
    y = _c(actual)
    return F.when(y == "H", F.col("p_h")).when(y == "D", F.col("p_d")).when(y == "A", F.col("p_a"))


def log_loss(actual: ColumnOrName) -> Column:
    return -F.ln(F.greatest(prob_of(actual), F.lit(LOG_LOSS_CLIP)))


def rps(actual: ColumnOrName) -> Column:
    """Ranked probability score over the order H, D, A."""
    y = _c(actual)
    hit_h = (y == "H").cast("double")
    hit_hd = (y != "A").cast("double")
    first = F.col("p_h") - hit_h
    second = F.col("p_h") + F.col("p_d") - hit_hd
    return (first * first + second * second) / 2


def brier(actual: ColumnOrName) -> Column:
    y = _c(actual)
    terms = [
        F.pow(F.col(p) - (y == o).cast("double"), 2)
        for o, p in zip(OUTCOMES, ("p_h", "p_d", "p_a"), strict=True)
    ]
    return terms[0] + terms[1] + terms[2]


def favourite() -> Column:
    """Most probable outcome; ties go in the order H, D, A."""
    h, d, a = F.col("p_h"), F.col("p_d"), F.col("p_a")
    return F.when((h >= d) & (h >= a), "H").when(d >= a, "D").otherwise("A")
