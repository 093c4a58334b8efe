"""CSV exports: encoding audit per file, then one all-string scan."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelloom.functions import encoding as enc
from panelloom.functions.text import quoted
from panelloom.model import EmptyDatasetError, IngestionError, SchemaMismatchError
from panelloom.sources.records import cells_of, first_records, header_names, records
from panelloom.sources.storage import store

SEQ = "__seq"  # position of a row in the input: (file, block, row)
BOM = "\ufeff"


def audit_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: encoding, mojibake verdict, byte-order mark, quoted line breaks.

    Decides as a whole-file decoder would: a file is UTF-8 if every line is; it is
    repaired only if every line survives the round trip and the file's total
    Turkish score rises. The facts kept per file are counts and flags only, so
    they are hashed and combined map-side; no line is sorted or shuffled.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file")
    )
    latin = "decode(cast(value AS binary), 'ISO-8859-1')"
    fixed = enc.undo_cp1252("value")
    # the round trip of plain ASCII is the text itself; skip the work
    lines = lines.selectExpr(
        "file",
        "value",
        f"startswith(value, {quoted(BOM)}) AS bom",
        "is_valid_utf8(value) AS utf8",
        f"{latin} RLIKE '[{enc.CP1254_UNDEFINED}]' AS undefined",
        "value RLIKE '[^\\\\x00-\\\\x7F]' AS wide",
        "replace(value, '\"\"', '') AS unescaped",
        f"is_valid_utf8(value) AND {enc.has_mojibake('value')} AS broken",
        f"NOT is_valid_utf8(value) AND {enc.has_legacy_mojibake(latin)} AS broken_legacy",
    ).withColumn(
        # a cell whose quote is not closed on its line, or a mark that looks like one
        "open",
        F.expr(
            "(length(unescaped) - length(replace(unescaped, '\"', ''))) % 2 = 1 "
            "OR unescaped RLIKE '(^|,)\"[^\"]*$'"
        ),
    ).withColumn("fixed", F.expr(f"CASE WHEN utf8 AND wide THEN {fixed} END"))
    gain = f"{enc.turkish_score('fixed')} - {enc.turkish_score('value')}"
    per_file = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.bool_and("utf8").alias("utf8"),
        F.bool_or("undefined").alias("undefined"),
        F.bool_or("broken").alias("broken"),
        F.bool_or("broken_legacy").alias("broken_legacy"),
        F.count_if("broken").alias("broken_lines"),
        F.expr("bool_and(CASE WHEN wide THEN fixed IS NOT NULL ELSE true END)").alias("reversible"),
        F.expr(f"sum(CASE WHEN fixed IS NOT NULL THEN {gain} ELSE 0 END)").alias("gain"),
        F.bool_or("open").alias("quoted_breaks"),
        F.bool_or("bom").alias("bom"),
    )
    encoding = "CASE WHEN utf8 THEN 'utf-8-sig' WHEN undefined THEN 'iso8859-9' ELSE 'cp1254' END"
    suspicious = "CASE WHEN utf8 THEN broken ELSE broken OR broken_legacy END"
    verdict = (
        f"CASE WHEN NOT ({suspicious}) THEN 'clean' "
        "WHEN utf8 AND reversible AND gain > 0 THEN 'repaired' ELSE 'suspect' END"
    )
    return per_file.selectExpr(
        "file",
        "lines",
        f"{encoding} AS encoding",
        f"{verdict} AS verdict",
        "broken_lines",
        "bom",
        "quoted_breaks",
    )


@dataclass(frozen=True)
class RawScan:
    """All-string rows of an input plus what the audit found about its files."""

    rows: DataFrame
    headers: tuple[str, ...]
    encoding: str
    repaired: bool
    suspect: bool
    repaired_lines: int  # lines of repaired files that were broken
    before_repair: DataFrame | None  # the rows of repaired files as they were read


@contextmanager
def reading(path) -> Iterator[None]:
    """Whatever Spark raises while an input is read becomes an IngestionError."""
    try:
        yield
    except PySparkException as error:
        raise IngestionError(f"cannot read {path}: {type(error).__name__}") from error


def scan_csv(spark: SparkSession, path: str | list[str]) -> RawScan:
    """Read every file of `path` with its own encoding; nothing is inferred.

    Short rows are filled with nulls, surplus cells dropped. Files of one kind without line
    breaks in cells are read by Spark's CSV source. All others are read in one scan too: their
    records are cut block by block and decoded by the verdict on their file. All files of an
    input must have the same header; one that differs raises instead of being misread.
    """
    with reading(path):
        audit = store(audit_files(spark, path), "audit")
        kinds = ["encoding", "verdict", "bom", "quoted_breaks"]
        # one row per kind of file, two dozen at most; a clean export has one
        counted = audit.groupBy(*kinds).agg(
            F.count(F.lit(1)).alias("files"), F.sum("broken_lines").alias("broken_lines")
        )
        groups = sorted(counted.collect(), key=str)
        if not groups:
            raise EmptyDatasetError("the input is empty")
        quoted_breaks = any(g["quoted_breaks"] for g in groups)
        if len(groups) == 1 and not quoted_breaks:
            rows = read_alike(spark, path, groups[0]["encoding"], groups[0]["files"] > 1)
            before = rows if groups[0]["verdict"] == "repaired" else None
            rows = rows if before is None else repair_all(rows)
        else:
            rows, before = read_mixed(spark, path, audit, quoted_breaks)
    repaired = [g for g in groups if g["verdict"] == "repaired"]
    labels = {g["encoding"] + (" (mojibake onarıldı)" if g in repaired else "") for g in groups}
    return RawScan(
        rows=nonblank(rows),
        headers=tuple(c for c in rows.columns if c != SEQ),
        encoding=", ".join(sorted(labels)),
        repaired=bool(repaired),
        suspect=any(g["verdict"] == "suspect" for g in groups),
        repaired_lines=sum(g["broken_lines"] for g in repaired),
        before_repair=before if repaired else None,
    )


def read_alike(spark: SparkSession, path, encoding: str, several: bool) -> DataFrame:
    """Files of one encoding, by Spark's CSV source."""
    utf8 = encoding == "utf-8-sig"
    reader = (
        spark.read.option("header", True)
        .option("mode", "PERMISSIVE")
        .option("escape", '"')
        .option("encoding", "UTF-8" if utf8 else "ISO-8859-1")
    )
    scanned = reader.csv(path)
    columns = scanned.columns
    if not any(c.strip(BOM).strip() for c in columns):
        raise EmptyDatasetError("the input has no header")
    if several:
        # check every file's header against the first one's
        scanned = reader.option("enforceSchema", False).schema(scanned.schema).csv(path)
    shown = columns
    if not utf8:
        keep = encoding == "iso8859-9"
        shown = [
            spark.range(1).selectExpr(enc.turkish_from_latin1(quoted(c), keep)).first()[0]
            for c in columns
        ]
    cells = []
    for raw, name in zip(columns, shown):
        ref = "`" + raw.replace("`", "``") + "`"
        cell = ref if utf8 else enc.turkish_from_latin1(ref, encoding == "iso8859-9")
        cells.append(F.expr(cell).alias(name.lstrip(BOM)))
    seq = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return scanned.select(*cells, seq.alias(SEQ))


def read_mixed(
    spark: SparkSession, path, audit: DataFrame, quoted_breaks: bool
) -> tuple[DataFrame, DataFrame]:
    """(rows, rows of repaired files as they were read), from one scan of the records.

    The verdicts, one row per file, are joined to the records by the hash of the file's path.
    """
    verdicts = audit.select(F.xxhash64("file").alias("key"), "file", "encoding", "verdict")
    text = (
        "CASE encoding WHEN 'utf-8-sig' THEN cast(encode(text, 'ISO-8859-1') AS string) "
        f"WHEN 'cp1254' THEN {enc.turkish_from_latin1('text')} "
        f"ELSE {enc.turkish_from_latin1('text', True)} END"
    )

    def decoded(found: DataFrame) -> DataFrame:
        return found.join(verdicts, "key").withColumn("text", F.expr(text))

    found = records(spark, path, quoted_breaks)
    is_header = F.expr("block = 0 AND row = 0")
    heads = decoded(found.where(is_header) if quoted_breaks else first_records(spark, path))
    found = decoded(found.where(~is_header))
    mended = f"CASE WHEN verdict = 'repaired' THEN coalesce({enc.undo_cp1252('text')}, text) ELSE text END"
    headers = heads.select(F.ltrim(F.expr(mended), F.lit(BOM)).alias("text")).distinct()
    first = [r["text"] for r in headers.limit(2).collect()]
    if not first or not header_names(first[0]):
        raise EmptyDatasetError("the input has no header")
    if len({tuple(header_names(h)) for h in first}) > 1:
        raise SchemaMismatchError("the files of the input differ in their header")
    names = header_names(first[0])
    seq = F.struct("file", "block", "row").alias(SEQ)
    rows = found.select(
        cells_of(F.col("text"), len(names)).alias("cells"), "verdict", seq
    )

    def repaired(cell: str) -> str:
        return f"CASE WHEN verdict = 'repaired' THEN coalesce({enc.undo_cp1252(cell)}, {cell}) ELSE {cell} END"

    places = range(len(names))
    cells = {name: f"cells.c{i}" for i, name in enumerate(names)}
    before = rows.where("verdict = 'repaired'").select(*[F.col(x).alias(n) for n, x in cells.items()], SEQ)
    # the array binds the cells to a name: a filter on them does not work them out again
    whole = F.array(F.struct(*[F.expr(repaired(f"cells.c{i}")).alias(f"c{i}") for i in places]))
    rows = rows.select(F.explode(whole).alias("cells"), SEQ)
    return rows.select(*[F.col(x).alias(n) for n, x in cells.items()], SEQ), before


def repair_all(rows: DataFrame) -> DataFrame:
    """Undo mojibake in every cell and header of files the audit found repairable."""
    out = []
    for c in rows.columns:
        if c == SEQ:
            out.append(F.col(SEQ))
            continue
        ref = "`" + c.replace("`", "``") + "`"
        out.append(F.expr(f"coalesce({enc.undo_cp1252(ref)}, {ref})").alias(repair_name(c)))
    return rows.select(*out)


def repair_name(name: str) -> str:
    try:
        return name.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return name


def nonblank(rows: DataFrame) -> DataFrame:
    """Drop rows whose cells are all null or blank."""
    filled = [
        F.expr("coalesce(`" + c.replace("`", "``") + "` RLIKE '(?U)\\\\S', false)")
        for c in rows.columns
        if c != SEQ
    ]
    return rows.filter(reduce(lambda a, b: a | b, filled))


def repair_samples(before: DataFrame, limit: int = 6) -> list[str]:
    """Up to `limit` distinct "before -> after" cells in input order."""
    names = [c for c in before.columns if c != SEQ]
    cells = ", ".join(f"trim(`{c}`)" for c in names)
    changed = (
        before.select(SEQ, F.posexplode(F.expr(f"array({cells})")).alias("pos", "old"))
        .filter(F.expr(enc.has_mojibake("old")))
        .groupBy("old")
        .agg(F.min(F.struct(SEQ, "pos")).alias("at"))
        .orderBy("at")
        .limit(limit)
        .select(F.expr(f"concat(old, ' -> ', coalesce({enc.undo_cp1252('old')}, old))").alias("s"))
    )
    return [r["s"] for r in changed.collect()]
