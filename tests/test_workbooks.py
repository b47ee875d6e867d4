"""The sink that writes workbooks from tasks: what is committed stays, once, and nothing else."""

import json
import zipfile

import pytest
from pyspark.sql import Row

from tabulens.sources import workbook


def row(project, place, label):
    return Row(project_id=project, sheet=workbook.SUMMARY, place=place, record=json.dumps({"label": label, "value": place}))


ROWS = [row("file:/drop/a.zip", 0, "first"), row("file:/drop/a.zip", 1, "second"), row("file:/drop/b.zip", 0, "third")]


def summary(path):
    with zipfile.ZipFile(path) as z:
        return z.read("xl/worksheets/sheet1.xml").decode()


def test_two_attempts_of_a_task_leave_one_file(tmp_path):
    writer = workbook.WorkbookWriter(str(tmp_path))
    lost, kept = writer.write(iter(ROWS)), writer.write(iter(ROWS))
    assert len(lost.files) == len(kept.files) == 2
    writer.commit([kept, None])
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(map(workbook.file_name, ("file:/drop/a.zip", "file:/drop/b.zip")))
    text = summary(tmp_path / workbook.file_name("file:/drop/a.zip"))
    assert text.index("first") < text.index("second") and "third" not in text


def test_a_second_job_replaces_the_first_and_an_aborted_one_leaves_nothing(tmp_path):
    for label in ("old", "new"):
        writer = workbook.WorkbookWriter(str(tmp_path))
        writer.commit([writer.write(iter([row("p", 0, label)]))])
    writer = workbook.WorkbookWriter(str(tmp_path))
    writer.abort([writer.write(iter([row("p", 0, "aborted")]))])
    files = list(tmp_path.iterdir())
    assert len(files) == 1 and "new" in summary(files[0])


def test_a_project_in_two_tasks_is_refused(tmp_path):
    writer = workbook.WorkbookWriter(str(tmp_path))
    with pytest.raises(ValueError, match="in one task"):
        writer.commit([writer.write(iter(ROWS[:1])), writer.write(iter(ROWS[1:]))])
    assert not list(tmp_path.iterdir())


def test_names_of_files():
    a, b = workbook.file_name("s3://x/1/my shop.v2.zip"), workbook.file_name("s3://x/2/my shop.v2.zip")
    assert a != b and a.startswith("my_shop.v2-") and a.endswith(".xlsx")
    assert workbook.file_name(".zip").startswith("project-")
