"""Scalar quality formulas, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bands(value: Column, steps: list[tuple[float, object]], last: object, upward: bool = True) -> Column:
    """The result of the first step that the value is within: at most it, or with ``upward`` false at least it."""
    out = None
    for bound, result in steps:
        test = value <= bound if upward else value >= bound
        out = F.when(test, F.lit(result)) if out is None else out.when(test, F.lit(result))
    return out.otherwise(F.lit(last))


def instability(afferent: Column, efferent: Column) -> Column:
    total = afferent + efferent
    return F.when(total > 0, efferent / total).otherwise(F.lit(0.0))


def distance_from_main(abstractness: Column, instability_: Column) -> Column:
    return F.abs(abstractness + instability_ - 1)


def maintainability(mean_complexity: Column, lines: Column) -> Column:
    return F.greatest(F.lit(0.0), 171.0 - 0.23 * mean_complexity - 16.2 * F.log(F.greatest(F.lit(1), lines).cast("double")))


def technical_debt(mean_complexity: Column, efferent: Column) -> Column:
    return F.least(F.lit(1.0), mean_complexity / 10.0 + efferent / 20.0)


def grade(complexity: Column, maintainability_: Column, instability_: Column, debt: Column) -> Column:
    score = (
        bands(complexity, [(10, 30), (20, 20), (50, 10)], 0)
        + bands(maintainability_, [(85, 30), (65, 20), (40, 10)], 0, upward=False)
        + bands(instability_, [(0.3, 20), (0.7, 15)], 10)
        + bands(debt, [(0.1, 20), (0.3, 10), (0.5, 5)], 0)
    )
    return bands(score, [(85, "A"), (70, "B"), (55, "C"), (40, "D")], "F", upward=False)


def status_bands(complexity: Column, maintainability_: Column, debt: Column) -> tuple[Column, Column, Column]:
    """good, warning or critical for each."""
    return (
        bands(complexity, [(10, "good"), (20, "warning")], "critical"),
        bands(maintainability_, [(80, "good"), (60, "warning")], "critical", upward=False),
        bands(debt, [(0.1, "good"), (0.25, "warning")], "critical"),
    )


def heat_band(count: Column, most: Column) -> Column:
    """0 for nothing, then 1 to 5 by the share of the greatest count."""
    share = count / most
    return F.when(count <= 0, 0).otherwise(bands(share, [(0.2, 1), (0.4, 2), (0.6, 3), (0.8, 4)], 5))


def size_tier(files: Column) -> Column:
    return F.when(files > 10000, "very_high").when(files > 5000, "high").when(files > 1000, "medium").otherwise("low")


def cycle_severity(kind: str, size: Column) -> Column:
    """Import cycles: high over 3 members, else medium; others: low up to 2, else medium."""
    if kind == "import":
        return F.when(size > 3, "high").otherwise("medium")
    return F.when(size <= 2, "low").otherwise("medium")


def strength_severity(size: Column, mean_strength: Column) -> Column:
    return (
        F.when(size <= 2, F.when(mean_strength < 2.0, "low").otherwise("medium"))
        .when(size <= 4, F.when(mean_strength < 3.0, "medium").otherwise("high"))
        .otherwise("high")
    )


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1).otherwise(0)


def code_lines(text: Column) -> tuple[Column, Column]:
    """Physical lines (not blank) and logical ones (not starting with a number sign either)."""
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))
    physical = F.filter(trimmed, lambda x: x != "")
    return F.size(physical), F.size(F.filter(physical, lambda x: ~x.startswith("#")))
