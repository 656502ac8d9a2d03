"""Rolling features by a table that names each one's source, rows and scope: it builds them, and it checks them by another way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators.features import past
from tallyfield.session import spread

#: The rows that windows have, and the names of features by source.
WINDOWS = [3, 5, 10]
MEANS = {
    "goals_for_ft": "goals_for_ft_avg", "goals_against_ft": "goals_against_ft_avg", "total_goals_ft": "total_goals_ft_avg", "points": "points_avg", "is_win": "win_rate", "is_draw": "draw_rate",
    "is_loss": "loss_rate", "shots_for": "shots_avg", "shots_against": "shots_allowed_avg", "shots_on_target_for": "shots_on_target_avg", "shots_on_target_against": "shots_on_target_allowed_avg",
    "corners_for": "corners_avg", "corners_against": "corners_allowed_avg",
}
RATES = ["shots_conversion_rate", "shots_on_target_rate"]
BY_SIDE = {"goals": "goals_for_ft", "shots": "shots_for", "corners": "corners_for"}


@dataclass(frozen=True)
class Feature:
    """A past mean: of ``source`` over ``rows`` rows of the team, or of the team at one side."""

    name: str
    source: str
    rows: int
    side: str | None = None

    @property
    def scope(self) -> str:
        return f"side:{self.side}" if self.side else "team"


def rolling_features() -> list[Feature]:
    """All of them, made from the names above."""
    out = [Feature(f"{name}_last_{n}", source, n) for source, name in MEANS.items() for n in WINDOWS]
    out += [Feature(f"{c}_avg_last_5", c, 5) for c in RATES]
    return out + [Feature(f"{side}_{word}_avg_last_5", source, 5, side) for word, source in BY_SIDE.items() for side in ("home", "away")]


def feature_of(name: str) -> Feature | None:
    """What a feature of this name is made of; None for any other name."""
    return next((f for f in rolling_features() if f.name == name), None)


def _own(f: Feature, side: str, value: Column) -> Column:
    return F.when(F.col(side) == f.side, value) if f.side else value


def build(df: DataFrame, team: str, side: str, order: list[str], spec: list[Feature] | None = None) -> DataFrame:
    """Adds the features whose source is there; one sort by team and side and one by team make them all.

    Nulls are skipped, a first row has null, and so has a row of the other
    side. ``order`` must tell all rows of a team apart. A team is a task's
    window, as its rows are its matches; teams are dealt out by numbers of
    rows (``spread``). The few features by side come first, so that rows are
    narrow when they are sorted.
    """
    chosen = [f for f in spec or rolling_features() if f.source in df.columns]
    d = spread(df, [team])
    for some in ([f for f in chosen if f.side], [f for f in chosen if not f.side]):
        d = d.withColumns({f.name: _own(f, side, F.avg(f.source).over(past([team, side] if f.side else [team], order, f.rows))) for f in some})
    return d.select(*df.columns, *[f.name for f in chosen])


def check(df: DataFrame, team: str, side: str, order: list[str], spec: list[Feature] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """A row for each feature that the table has: feature, source, rows, scope, total_rows, filled, first_filled and differing.

    A past mean is made again from running sums and counts that end before the
    row, so a feature that sees its own row, or a later one, differs.
    ``first_filled`` counts first rows of a team that have a value. The table
    is read once for all features.
    """
    chosen = [f for f in spec or rolling_features() if f.name in df.columns and f.source in df.columns]
    if not chosen:
        return df.sparkSession.createDataFrame([], "feature string, source string, rows int, scope string, total_rows long, filled long, first_filled long, differing long")

    def again(f: Feature) -> Column:
        w = Window.partitionBy(*([team, side] if f.side else [team])).orderBy(*order)
        before, earlier = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, -f.rows - 1)
        value = F.col(f.source).cast("double")
        total = F.coalesce(F.sum(value).over(before), F.lit(0.0)) - F.coalesce(F.sum(value).over(earlier), F.lit(0.0))
        return _own(f, side, F.try_divide(total, F.count(value).over(before) - F.count(value).over(earlier)))

    def same(f: Feature) -> Column:
        x, y = F.col(f.name), F.col(f"_again_{f.name}")
        return x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))

    d = df
    for some in ([f for f in chosen if f.side], [f for f in chosen if not f.side]):  # as in ``build``: what is sorted by team next has only what was found by side
        d = d.withColumns({f"_again_{f.name}": again(f) for f in some})
        d = d.withColumns({f"_same_{f.name}": same(f) for f in some}).drop(*[f"_again_{f.name}" for f in some])
    d = d.withColumn("_first", F.row_number().over(Window.partitionBy(team).orderBy(*order)) == 1)

    def row(f: Feature) -> Column:
        x = F.col(f.name)
        number = lambda test: F.count(F.when(test, 1))
        facts = {"total_rows": F.count(F.lit(1)), "filled": F.count(x), "first_filled": number(F.col("_first") & x.isNotNull()), "differing": number(~F.col(f"_same_{f.name}"))}
        return F.struct(F.lit(f.name).alias("feature"), F.lit(f.source).alias("source"), F.lit(f.rows).alias("rows"), F.lit(f.scope).alias("scope"), *[c.alias(n) for n, c in facts.items()])

    return d.agg(F.array(*[row(f) for f in chosen]).alias("all")).select(F.inline("all"))
