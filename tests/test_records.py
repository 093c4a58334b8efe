"""Records with line breaks in cells, cut block by block, and folders of mixed encodings."""

import csv
import io
import random

import pytest

from panelloom.model import EmptyDatasetError, IngestionError, SchemaMismatchError
from panelloom.sources import records as rec
from panelloom.sources.csv_scan import SEQ, audit_files, scan_csv


@pytest.fixture
def small_blocks(spark):
    """Files are split into blocks of so many bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield of
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def cell(draw):
    return draw.choice(
        ["plain", "", "a b", '5" pipe', "x" * draw.randrange(40), "two\nlines", 'a "quoted" word', "comma, here",
         'break\n"and" quote\n\nblank line', '"', '""', "\n", "ends\n", "ş ğ"]
    )


def quoted(text, draw):
    """As a CSV cell: quoted where needed, inch marks inside plain cells as they are."""
    if any(c in text for c in ',\n') or text.startswith('"') or draw.random() < 0.2:
        return '"' + text.replace('"', '""') + '"'
    return text


def written(rows, draw):
    return "\n".join(",".join(quoted(c, draw) for c in row) for row in rows) + draw.choice(["", "\n", "\n\n"])


def read_rows(scan):
    names = [c for c in scan.rows.columns if c != SEQ]
    return sorted(tuple(r[c] or "" for c in names) for r in scan.rows.collect())


@pytest.mark.parametrize("seed", range(2))
def test_cut_as_one_task_would(spark, tmp_path, small_blocks, seed):
    draw = random.Random(seed)
    rows = [("k", *[cell(draw) for _ in range(2)]) for _ in range(45)]
    header = ("id", "name", 'note "x"' if seed % 2 else "note")
    for i in range(3):
        (tmp_path / f"f{i}.csv").write_text(written([header, *rows[i * 15 : i * 15 + 15]], draw), encoding="utf-8")
    whole = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path))
    )
    want = sorted(tuple(c or "" for c in r) for r in whole.collect())
    assert want == sorted(rows)
    for size in (10_000_000, 300, 61):
        small_blocks(size)
        scan = scan_csv(spark, str(tmp_path))
        assert scan.headers == tuple(header) and read_rows(scan) == want


def test_as_many_tasks_as_blocks(spark, tmp_path, small_blocks):
    lines = [f"{i},plain" for i in range(900)]
    lines[500] = '500,"one\nbreak"'
    (tmp_path / "f.csv").write_text("\n".join(["id,name", *lines]))
    small_blocks(600)
    blocks = rec.latin_lines(spark, str(tmp_path)).rdd.getNumPartitions()
    assert blocks > 10
    cut = rec.cut(rec.latin_lines(spark, str(tmp_path)), [])
    assert cut.rdd.getNumPartitions() == blocks
    scan = scan_csv(spark, str(tmp_path))
    assert scan.rows.count() == 900 and scan.rows.where("name = 'one\nbreak'").count() == 1


def test_order_of_rows_follows_the_file(spark, tmp_path, small_blocks):
    body = "\n".join(f'{i},"a\nb"' if i % 9 == 0 else f"{i},x" for i in range(150))
    (tmp_path / "f.csv").write_text(f"id,name\n{body}\n")
    small_blocks(200)
    got = [int(r["id"]) for r in scan_csv(spark, str(tmp_path)).rows.orderBy(SEQ).collect()]
    assert got == list(range(150))


def test_inch_marks_change_nothing(spark, tmp_path):
    text = 'id,size\n1,5" pipe\n2,7"" pipe\n3,a "b" c\n4,"x, 5"" y"\n5,6"\n'
    (tmp_path / "f.csv").write_text(text)
    assert read_rows(scan_csv(spark, str(tmp_path))) == [
        ("1", '5" pipe'), ("2", '7"" pipe'), ("3", 'a "b" c'), ("4", 'x, 5" y'), ("5", '6"'),
    ]


def test_states_of_single_lines():
    for line, outside, inside in [
        ("a,b", False, True), ('"a', True, False), ('a"', False, False), ('"a"', False, True), ('"a""', True, True),
        ('x,"', True, False), ('","', False, True), ('a","b', True, True), ("", False, True), ('a"b,"c', True, True),
    ]:
        assert rec.inside_after(line, False) == outside, line
    for draw in (random.Random(i) for i in range(300)):
        rows = [[cell(draw) for _ in range(3)] for _ in range(4)]
        text, state, seen = written(rows, draw).rstrip("\n"), False, []
        lines = text.split("\n")
        for line in lines:
            state = rec.inside_after(line, state)
            seen.append(state)
        ends = [i for i, s in enumerate(seen) if not s and lines[i].strip()]
        assert len(ends) == len([r for r in csv.reader(io.StringIO(text)) if r])


def test_blocks_compose(spark):
    """Whatever blocks do to either state, the window agrees with going through them in turn."""
    draw = random.Random(3)
    rows = [(k, b * 10, draw.random() < 0.5, draw.random() < 0.5) for k in range(20) for b in range(30)]
    ends = spark.createDataFrame(rows, "key long, block long, from_outside boolean, from_inside boolean")
    want = set()
    for k in range(20):
        state = False
        for key, block, from_outside, from_inside in rows:
            if key == k:
                if state:
                    want.add((k, block))
                state = from_inside if state else from_outside
    assert {tuple(r) for r in rec.blocks_inside(ends).collect()} == want


def test_mixed_folder_is_one_scan(spark, tmp_path):
    text = "ad,not\nDöşemelik Ağır,1\nİş Çantası,2\n"
    (tmp_path / "a.csv").write_bytes(text.encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes(text.encode("cp1254"))
    (tmp_path / "c.csv").write_bytes("ad,not\nDöşemelik,3\n".encode().decode("latin-1").translate(
        {b: bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    ).encode("utf-8"))
    (tmp_path / "d.csv").write_bytes("ad,not\nkâr\x81,4\n".encode("iso8859-9"))
    scan = scan_csv(spark, str(tmp_path))
    assert read_rows(scan) == sorted(
        [("Döşemelik Ağır", "1"), ("İş Çantası", "2")] * 2 + [("Döşemelik", "3"), ("kâr\x81", "4")]
    )
    assert scan.repaired and scan.repaired_lines == 1 and [r["ad"] for r in scan.before_repair.collect()] == ["DÃ¶ÅŸemelik"]
    assert audit_files(spark, str(tmp_path)).count() == 4


def test_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text("a,c\n1,2\n")
    with pytest.raises(SchemaMismatchError):
        scan_csv(spark, str(tmp_path))


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n\na,,A\n"1\n2"\n1,2,3,4\n"never closed\n5\n')
    scan = scan_csv(spark, str(tmp_path))
    assert scan.headers == ("a0", "_c1", "A2")
    assert read_rows(scan) == [("1", "2", "3"), ("1\n2", "", ""), ("never closed\n5", "", "")]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.csv").write_text('"\n')
    with pytest.raises(EmptyDatasetError):
        scan_csv(spark, str(tmp_path / "empty"))
    with pytest.raises(IngestionError):
        scan_csv(spark, str(tmp_path / "not there"))
