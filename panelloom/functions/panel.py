"""Window and aggregate building blocks over an (entity, period) panel.

Frames are row based: a missing month is skipped, never padded. Aggregates that
look at one row of an entity (first, last, first three, ...) are conditional
aggregates over the row number, so they combine map-side and need no ordering
inside the aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec, functions as F

ROW = "__row"  # 0-based position of the row within its entity
ROWS = "__rows"  # number of rows of the entity
SEEN_PERIOD = "__seen_period"  # period and label of the entity's previous row
SEEN_LABEL = "__seen_label"
CHANGE = "__change"  # change of the trend column against that row


class _Columns:
    """`c.name` is `col("name")`; packs are imported before a session exists."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


c = _Columns()


def safe_ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    return F.when(denominator > 0, numerator / denominator * F.lit(float(scale)))


def total(x: Column) -> Column:
    """Sum that is 0, not null, over no values."""
    return F.coalesce(F.sum(x), F.lit(0).cast("double"))


@dataclass(frozen=True)
class Panel:
    """Column names of a panel plus the windows and aggregates built on them."""

    entity: str
    period: str
    label: str
    # Optional column that splits an entity's rows into separate histories. A hash
    # exchange on the entity alone still serves the windows.
    split: str | None = None

    # -- windows -----------------------------------------------------------
    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*[k for k in (self.entity, self.split) if k])

    @property
    def history(self) -> WindowSpec:
        return self.whole.orderBy(self.period)

    def previous(self, x: Column) -> Column:
        return F.lag(x).over(self.history)

    def following(self, x: Column) -> Column:
        return F.lead(x).over(self.history)

    def trailing_mean(self, x: Column, rows: int) -> Column:
        return F.avg(x).over(self.history.rowsBetween(1 - rows, 0))

    def own_median(self, x: Column) -> Column:
        return F.median(x).over(self.whole)

    def percent_change(self, x: Column) -> Column:
        """Change against the previous row in percent, nulls carried forward.

        A zero base gives +inf, -inf or NaN as IEEE division does; ANSI mode
        would raise on it, so the three cases are spelled out.
        """
        before = F.last(x, ignorenulls=True).over(
            self.history.rowsBetween(Window.unboundedPreceding, -1)
        )
        now = F.coalesce(x, before)
        change = (
            F.when(before != 0, (now - before) / before)
            .when(before.isNull() | now.isNull(), F.lit(None).cast("double"))
            .when(now > 0, F.lit(float("inf")))
            .when(now < 0, F.lit(float("-inf")))
            .otherwise(F.lit(float("nan")))
        )
        return change * 100

    # -- aggregates over the rows of one entity ----------------------------
    def first(self, x: Column) -> Column:
        return F.max(F.when(F.col(ROW) == 0, x))

    def last(self, x: Column) -> Column:
        return F.max(F.when(F.col(ROW) == F.col(ROWS) - 1, x))

    def head_mean(self, x: Column, rows: int) -> Column:
        return F.avg(F.when(F.col(ROW) < rows, x))

    def tail_mean(self, x: Column, rows: int) -> Column:
        return F.avg(F.when(F.col(ROW) >= F.col(ROWS) - rows, x))

    def onset(self, condition: Column) -> Column:
        """First period in which the condition held."""
        return F.min(F.when(condition, F.col(self.period)))

    def peak_period(self, x: Column) -> Column:
        """Period of the largest value, the earliest one on a tie."""
        return F.max_by(
            F.when(x.isNotNull(), F.col(self.period)),
            F.when(x.isNotNull(), F.struct(x, -F.col(ROW))),
        )

    def step(self, x: Column) -> Column:
        """Mean change per row from first to last; 0 for a single row."""
        steps = F.count(F.lit(1)) - 1
        return F.when(steps > 0, (self.last(x) - self.first(x)) / steps).otherwise(F.lit(0.0))

    def growth_percent(self, x: Column) -> Column:
        """First-to-last change in percent, null unless the first value is positive."""
        first = self.first(x)
        return F.when(first > 0, (self.last(x) - first) / first * 100)

    def entity_count(self) -> Column:
        """Distinct entities of a (group, period) cell.

        The panel holds one row per (entity, period), so within one period a
        plain count is the exact distinct count and needs no extra shuffle.
        """
        return F.count(F.col(self.entity))
