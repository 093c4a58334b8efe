"""Imputation rules: fill nulls from the panel's own consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelloom.pack import ReportPack

FLAG = "__imputed"
TOLERANCE = 0.5  # estimates ahead and back may differ by so much


def impute(panel: DataFrame, pack: ReportPack) -> DataFrame:
    """Apply the pack's rules in order; later rules see earlier fills.

    Adds per target `<target>__imputed`, and `__conflict_<target>` plus the two
    estimates where a rule also estimates backwards. One pass, all windows on
    the entity; the sort is asked for up front so that medians and lags share it.
    """
    p = pack.panel
    panel = panel.repartition(pack.entity).sortWithinPartitions(pack.entity, pack.period)
    for rule in pack.fills:
        if rule.target not in panel.columns:
            continue
        target = F.col(rule.target)
        forward = f"__fwd_{rule.target}"
        panel = panel.withColumn(forward, rule.ahead(p))
        filled = target.isNull() & F.col(forward).isNotNull()
        new = {f"{rule.target}{FLAG}": filled}
        if rule.back is not None:
            backward = f"__bwd_{rule.target}"
            panel = panel.withColumn(backward, rule.back(p))
            apart = F.abs(F.col(forward) - F.col(backward)) > TOLERANCE
            new[f"__conflict_{rule.target}"] = F.coalesce(
                target.isNull() & apart, F.lit(False)
            )
        new[rule.target] = F.coalesce(target, F.col(forward))
        panel = panel.withColumns(new)
        if rule.back is None:
            panel = panel.drop(forward)
    return panel
