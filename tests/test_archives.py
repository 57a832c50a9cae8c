"""Zip archives as data sources: members as partitions, blocks smaller than a member, strict errors, reports."""

from __future__ import annotations

import hashlib
import zipfile

import pytest

from latentia.sources import archives, ticks


def line(i: int, stamp: int) -> str:
    return f"{i},{i / 4 + 1},1,1,1,{stamp},True,False\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("zips")
    with zipfile.ZipFile(at / "A-2024-01.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("A-2024-01.csv", "".join(line(i, 1_650_000_000_000 + i) for i in range(5000)))
    with zipfile.ZipFile(at / "A-2025-01.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.csv", line(1, 1_735_689_600_000_123))
        z.writestr("two.csv", line(2, 1_735_689_600_000_124) + line(3, 1_735_689_600_000_125))
        z.writestr("notes.txt", "not ticks")
    (at / "B-bad.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(at / "C-empty.zip", "w") as z:
        z.writestr("C.csv", "")
    return at


def test_members_are_partitions_read_in_blocks(spark, folder):
    """A block is a fiftieth of the first member; rows are the same and come from one partition for each member."""
    whole = ticks.zip_ticks(spark, str(folder / "A-*.zip"), members="all")
    assert whole.rdd.getNumPartitions() == 3
    rows = [(r["symbol"], r["us"], r["seq"], r["price"]) for r in whole.orderBy("us").collect()]
    assert rows[:5000] == [("A-2024-01", (1_650_000_000_000 + i) * 1000, i, i / 4 + 1) for i in range(5000)]
    assert rows[5000:] == [("A-2025-01", 1_735_689_600_000_123 + i, i + 1, (i + 1) / 4 + 1) for i in range(3)]
    reader = archives.TickReader(str(folder / "A-2024-01.zip"), "strict", 4096)
    batches = list(reader.read(reader.partitions()[0]))
    assert len(batches) > 40 and max(b.num_rows for b in batches) < 200 and sum(b.num_rows for b in batches) == 5000
    assert ticks.zip_ticks(spark, f"file://{folder}/A-2024-01.zip").count() == 5000


def test_first_member_and_strict_errors(spark, folder):
    assert [r["seq"] for r in ticks.zip_ticks(spark, str(folder / "A-2025-01.zip")).collect()] == [1]
    for name in ("A-2025-01.zip", "A-*.zip"):
        with pytest.raises(Exception, match="expected exactly one CSV member, found 2"):
            ticks.zip_ticks(spark, str(folder / name), strict=True).count()
    assert ticks.zip_ticks(spark, str(folder / "C-empty.zip"), strict=True).count() == 0
    assert ticks.zip_ticks(spark, str(folder / "nothing-*.zip")).count() == 0
    with pytest.raises(Exception, match="gone.zip"):
        ticks.zip_ticks(spark, str(folder / "gone.zip")).count()


def test_report_counts_and_adds_up(spark, folder):
    got = {r["file"]: (r["members"], r["status"], r["rows"]) for r in ticks.archive_report(spark, str(folder), total=True).collect()}
    assert got == {"A-2024-01.zip": (1, "ok", 5000), "A-2025-01.zip": (2, "not one CSV", None), "B-bad.zip": (0, "invalid", None), "C-empty.zip": (1, "ok", 0), "total": (4, "incomplete", 5000)}
    assert {r["file"]: r["status"] for r in ticks.archive_report(spark, str(folder / "[AC]-*4-01.zip"), total=True).collect()} == {"A-2024-01.zip": "ok", "total": "ok"}


def test_digests_are_of_whole_files(spark, folder):
    manifest = spark.createDataFrame([(n, hashlib.sha256((folder / n).read_bytes()).hexdigest()) for n in ("A-2024-01.zip", "B-bad.zip")] + [("C-empty.zip", "00")], "file string, line string")
    got = {r["file"]: r["ok"] for r in ticks.checksums(spark, str(folder), manifest).collect()}
    assert got == {"A-2024-01.zip": True, "B-bad.zip": True, "C-empty.zip": False, "A-2025-01.zip": False}
