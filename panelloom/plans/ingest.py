"""Raw export -> checked panel, quarantine and quality report.

Two tables are written: the typed rows, and the panel with imputations, metrics
and rule results. Every count of the report is observed during those writes;
only issue rows, at most a few dozen, reach the driver.
"""

from __future__ import annotations

from contextlib import nullcontext
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelloom.functions.text import fixed_sql
from panelloom.model import ISSUE, EmptyDatasetError
from panelloom.operators import quality
from panelloom.operators.coerce import (
    bad_period,
    coerce,
    drop_bad_periods,
    map_columns,
    missing_counts,
    unknown_columns,
)
from panelloom.operators.dedup import COPIES, VARIANTS, deduplicate
from panelloom.operators.impute import FLAG, impute
from panelloom.operators.series import build_series
from panelloom.pack import ReportPack, Stage
from panelloom.packs.registry import detect_pack, get_pack
from panelloom.plans.issue_texts import AMBIGUOUS_NOTE, IMPUTED, ISSUES
from panelloom.sources.csv_scan import SEQ, nonblank, reading, repair_samples, scan_csv
from panelloom.sources.storage import store_observed

COMPLETE = "__complete"


@dataclass(frozen=True)
class IngestOutcome:
    """`series` holds the clean rows with metrics and helper columns."""

    pack: ReportPack
    series: DataFrame
    clean: DataFrame
    quarantined: DataFrame
    issues: DataFrame
    report: DataFrame
    imputed_columns: tuple[str, ...]
    counts: dict[str, int]


class IssueList:
    """Issues in the order found; a handful of driver-side rows."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, code, affected, samples=(), note="", text=None, **values) -> None:
        title, severity, action, detail = text or ISSUES[code]
        values.setdefault("count", affected)
        self.rows.append(
            (
                len(self.rows),
                code,
                title.format(**values),
                severity,
                action,
                affected,
                detail.format(**values) + note,
                list(samples),
            )
        )


def texts(frame: DataFrame) -> list[str]:
    """The single text column of a frame already limited to a few rows."""
    return [r[0] for r in frame.collect()]


def ingest(spark: SparkSession, path: str, pack_key: str | None = None) -> IngestOutcome:
    """Ingest the CSV files of `path`; the report type is detected if not given."""
    scan = scan_csv(spark, path)
    pack = get_pack(pack_key) if pack_key else detect_pack([h.strip() for h in scan.headers])
    if pack is None:
        raise EmptyDatasetError("no known report type has these columns; name the pack")
    found = IssueList()
    if scan.repaired:
        samples = repair_samples(scan.before_repair)
        found.add("ENCODING_REPAIRED", scan.repaired_lines, samples)
    if scan.suspect:
        found.add("ENCODING_SUSPECT", 0)
    return ingest_rows(scan.rows, pack, SEQ, found, scan.encoding, scan.repaired, path)


def ingest_frame(rows: DataFrame, pack: ReportPack, seq: str) -> IngestOutcome:
    """Ingest all-string rows already in Spark; `seq` orders them."""
    rows = rows.withColumnRenamed(seq, SEQ)
    return ingest_rows(nonblank(rows), pack, SEQ, IssueList(), "", False)


def ingest_rows(
    rows: DataFrame, pack: ReportPack, seq: str, found: IssueList, encoding: str, repaired: bool,
    path: str | None = None,
) -> IngestOutcome:
    headers = [c for c in rows.columns if c != seq]
    typed = coerce(map_columns(rows, pack, keep=(seq,)), pack)
    with reading(path) if path else nullcontext():
        typed, seen = store_observed(
            typed,
            "typed",
            {
                "raw_rows": F.count(F.lit(1)),
                "bad_periods": F.count_if(bad_period(pack)),
                **missing_counts(pack, typed.columns),
            },
        )
    if not seen["raw_rows"]:
        raise EmptyDatasetError("no row below the header")
    report_typing(found, typed, pack, headers, seen)

    usable = drop_bad_periods(typed, pack, bool(seen["bad_periods"]))
    panel = impute(deduplicate(usable, pack, seq), pack)
    panel = panel.withColumn(COMPLETE, quality.is_complete(pack, panel.columns))
    by_completeness = replace(pack.panel, split=COMPLETE)
    series = quality.with_violations(
        build_series(panel, pack, by_completeness), pack, by_completeness
    )
    series, counts = store_observed(series, "panel", panel_counts(series, pack))
    counts |= seen

    samples = read_samples(series, pack, counts)
    report_panel(found, pack, counts, samples)
    if not counts["clean"]:
        raise EmptyDatasetError("every row is quarantined; nothing is left to analyse")
    report_integrity(found, pack, counts, samples)

    imputed = tuple(r.target for r in pack.fills if counts.get(f"filled_{r.target}"))
    flags = [f"{t}{FLAG}" for t in imputed]
    data = [c for c in pack.schema.names if c in series.columns]
    shown = [*data, *flags]
    return IngestOutcome(
        pack=pack,
        series=series.filter(COMPLETE).drop(
            *[c for c in series.columns if c.endswith(FLAG) and c not in flags]
        ),
        clean=series.filter(COMPLETE).select(*shown),
        quarantined=series.filter(~F.col(COMPLETE)).select(*shown),
        issues=issue_frame(rows.sparkSession, found),
        report=report_frame(rows.sparkSession, found, counts, encoding, repaired),
        imputed_columns=imputed,
        counts=counts,
    )


def panel_counts(series: DataFrame, pack: ReportPack) -> dict[str, Column]:
    clean = F.col(COMPLETE)
    counts = {
        "clean": F.count_if(clean),
        "quarantined": F.count_if(~clean),
        "exact_removed": F.sum(F.col(COPIES) - F.col(VARIANTS)),
        "key_removed": F.sum(F.col(VARIANTS) - 1),
    }
    for rule in pack.fills:
        if f"{rule.target}{FLAG}" in series.columns:
            counts[f"filled_{rule.target}"] = F.count_if(F.col(f"{rule.target}{FLAG}"))
        if f"__conflict_{rule.target}" in series.columns:
            counts[f"conflict_{rule.target}"] = F.count_if(F.col(f"__conflict_{rule.target}"))
    for name in quality.violation_columns(series):
        counts[name] = F.count_if(clean & F.col(name))
    return counts


def report_typing(
    found: IssueList, typed: DataFrame, pack: ReportPack, headers: list[str], seen: dict[str, int]
) -> None:
    unknown = unknown_columns(headers, pack)
    if unknown:
        found.add("UNKNOWN_COLUMNS", 0, unknown[:8])
    for name in pack.measures:
        if seen.get(f"missing_{name}"):
            found.add("MISSING_DETECTED", seen[f"missing_{name}"], label=pack.describe(name)[0])
    if seen["bad_periods"]:
        period = F.col(pack.period)
        bad = typed.filter(bad_period(pack)).select(period).distinct().orderBy(period).limit(5)
        found.add("INVALID_PERIOD_FORMAT", seen["bad_periods"], texts(bad))


GAPS = "PERIOD_GAP"
CHECKED = "isaretlendi"  # fixed value: what is done about a row that breaks a rule
GAP_TOTALS = "__gap_totals"


def read_samples(series: DataFrame, pack: ReportPack, counts: dict[str, int]) -> dict[str, list[str]]:
    """The sample texts of every rule that has affected rows, and the totals of gaps, from one job."""
    e, p = pack.entity, pack.period
    key = f"concat(coalesce({e}, 'None'), ' / ', coalesce({p}, 'None'))"
    rules: dict[str, tuple[Column, Column]] = {}
    if counts["key_removed"]:
        rules["DUPLICATE_KEY"] = (F.col(VARIANTS) > 1, F.expr(f"concat({key}, ' (', {VARIANTS}, ' kayıt)')"))
    for rule in pack.fills:
        if counts.get(f"conflict_{rule.target}"):
            ahead, back = (fixed_sql(f"__{way}_{rule.target}", 0) for way in ("fwd", "bwd"))
            text = F.expr(f"concat({key}, ': ileri=', {ahead}, ' geri=', {back})")
            rules[f"conflict_{rule.target}"] = (F.col(f"__conflict_{rule.target}"), text)
    if counts["quarantined"]:
        rules["ROW_QUARANTINED"] = (~F.col(COMPLETE), F.expr(key))
    for rule in pack.found_at(Stage.WINDOW):
        if counts.get(f"__bad_{rule.code}"):
            names = [n for n in rule.shows if n in series.columns] or [e, p]
            rules[f"__bad_{rule.code}"] = (F.col(COMPLETE) & F.col(f"__bad_{rule.code}"), quality.sample_text(pack, names))
    gaps = quality.period_gaps(series, pack)
    none = F.lit(None).cast("string")
    text = F.expr(f"concat(coalesce({e}, 'None'), ': ', periods, '/', all_periods, ' dönem')")
    shown = gaps.select(F.lit(GAPS).alias("rule"), F.col(e).alias("entity"), none.alias("period"), text.alias("sample"))
    totals = gaps.agg(F.concat_ws("/", F.count(F.lit(1)), F.max("all_periods")).alias("sample")).select(
        F.lit(GAP_TOTALS).alias("rule"), none.alias("entity"), none.alias("period"), "sample"
    )
    found = quality.sample_lists(series, rules, pack, shown, totals)
    return {r["rule"]: r["samples"] for r in found.collect()}


def report_panel(found: IssueList, pack: ReportPack, counts: dict[str, int], samples: dict[str, list[str]]) -> None:
    if counts["exact_removed"]:
        found.add("DUPLICATE_EXACT", counts["exact_removed"])
    if counts["key_removed"]:
        found.add("DUPLICATE_KEY", counts["key_removed"], samples["DUPLICATE_KEY"])
    for rule in pack.fills:
        conflicts = counts.get(f"conflict_{rule.target}", 0)
        if conflicts:
            found.add("IMPUTATION_AMBIGUOUS", conflicts, samples[f"conflict_{rule.target}"])
        filled = counts.get(f"filled_{rule.target}", 0)
        if filled:
            note = AMBIGUOUS_NOTE if conflicts else ""
            title, detail = pack.wording.fills[rule.target]
            found.add(rule.code, filled, note=note, text=(title, *IMPUTED, detail))
    if GAPS in samples:
        total, periods = map(int, samples[GAP_TOTALS][0].split("/"))
        found.add(GAPS, total, samples[GAPS], periods=periods)
    if counts["quarantined"]:
        found.add("ROW_QUARANTINED", counts["quarantined"], samples["ROW_QUARANTINED"])


def report_integrity(found: IssueList, pack: ReportPack, counts: dict[str, int], samples: dict[str, list[str]]) -> None:
    for rule in pack.found_at(Stage.WINDOW):
        affected = counts.get(f"__bad_{rule.code}", 0)
        if affected:
            title, detail = pack.wording.checks[rule.code]
            text = (title, rule.severity, CHECKED, detail)
            found.add(rule.code, affected, samples[f"__bad_{rule.code}"], text=text)


def issue_frame(spark: SparkSession, found: IssueList) -> DataFrame:
    return quality.ordered_issues(spark.createDataFrame(found.rows, ISSUE))


def report_frame(
    spark: SparkSession, found: IssueList, counts: dict[str, int], encoding: str, repaired: bool
) -> DataFrame:
    """The quality report: one row with counts, health score and nested issues."""
    issues = spark.createDataFrame(found.rows, ISSUE)
    ranked = F.struct(
        F.expr("map('kritik', 0, 'yuksek', 1, 'orta', 2, 'dusuk', 3, 'bilgi', 4)[severity] AS rank"),
        "step", "code", "title", "severity", "action", "affected_rows", "detail", "samples",
    )
    listed = issues.agg(F.sort_array(F.collect_list(ranked)).alias("issues"))
    score = quality.health(issues, F.lit(counts["raw_rows"]))
    numbers = score.select(
        F.lit(counts["raw_rows"]).cast("bigint").alias("raw_row_count"),
        F.lit(counts["clean"]).cast("bigint").alias("clean_row_count"),
        F.lit(counts["quarantined"]).cast("bigint").alias("quarantined_row_count"),
        F.lit(encoding).alias("encoding_detected"),
        F.lit(repaired).alias("encoding_repaired"),
        "health_score",
        "issue_count",
        (F.lit(counts["clean"]) == 0).alias("has_blocking_issues"),
        listed.scalar().alias("ranked"),
    )
    return numbers.select(
        "*", F.expr("transform(ranked, i -> named_struct('code', i.code, 'title', i.title, "
                    "'severity', i.severity, 'action', i.action, 'affected_rows', i.affected_rows, "
                    "'detail', i.detail, 'samples', i.samples))").alias("issues"),
    ).drop("ranked")
