import glob
import os

import pytest
from pyspark.sql import functions as F

from fieldsift import fixed_values as V
from fieldsift.sources import sinks

ALLOWED = {"taxonomy": ["wall", 'a "b", c'], "defectPattern": list(V.DEFECT_PATTERNS)}


def tables(spark, **instead):
    hashed = ["0123456789abcdef", "fedcba9876543210"]
    judged = [(hashed[0], "site-001", "2024-05", "wall", "", "0", "0"), (hashed[1], "site-002", "2024-06", 'a "b", c', "wall", "1", "0")]
    boxes = [(hashed[0], V.DEFECT_PATTERNS[0], None, "[1, 2, 3, 1000]", "human")]
    rows = {"judgements": judged, "defect_boxes": boxes, "qs_criteria": []} | instead
    return {n: spark.createDataFrame(r, ", ".join(f"{c} string" for c in V.PACK_TABLES[n])) for n, r in rows.items()}


def publish(given, path, **more):
    return sinks.publish_pack(given, ALLOWED, path, **{"version": "p1", "boundary": "text", **more})


def test_published_and_read_back(spark, tmp_path):
    path = str(tmp_path / "p1")
    said = publish(tables(spark), path, licensed=True, stats={"skipped": 3}).first()
    assert said.counts == {"judgements": 2, "defect_boxes": 1, "qs_criteria": 0} and said.stats == {"skipped": 3}
    assert said.judgementBreakdown.asDict() == {"ruleSilent": 1, "agree": 0, "overridden": 1} and said.distribution == "licensed-external"
    back = sinks.read_pack(spark, path)
    assert sorted(r.humanClass for r in back["judgements"].collect()) == ['a "b", c', "wall"]
    assert [r.qsCode for r in back["defect_boxes"].collect()] == [""] and back["qs_criteria"].isEmpty()
    assert os.listdir(tmp_path) == ["p1"]
    with pytest.raises(sinks.PackError, match="exists"):
        publish(tables(spark), path)


BAD = [
    ("judgements", ("x" * 16, "site-001", "2024-05", "wall", "", "0", "0")),
    ("judgements", ("0" * 16, "site-001", "2024-05", "secret class", "", "0", "0")),
    ("judgements", ("0" * 16, None, "2024-05", "wall", "", "0", "0")),
    ("judgements", ("0" * 16, "site-001", "2024-05", "wall", "", " 0", "0")),
    ("judgements", ("0" * 16, "site-001", "2024-05", "wall", "", "0\n", "0")),
    ("defect_boxes", ("0" * 16, V.DEFECT_PATTERNS[0], "", "[1, 2, 3, 1001]", "human")),
]


@pytest.mark.parametrize("name, row", BAD)
def test_one_bad_cell_leaves_nothing(spark, tmp_path, name, row):
    with pytest.raises(sinks.PackError, match=name) as told:
        publish(tables(spark, **{name: [row]}), str(tmp_path / "p1"))
    assert "secret" not in str(told.value) and os.listdir(tmp_path) == []


def test_unfit_tables_leave_nothing(spark, tmp_path):
    path, given = str(tmp_path / "p1"), tables(spark)
    wrong = [
        given | {"judgements": given["judgements"].withColumn("title", F.lit("x"))},
        given | {"judgements": given["judgements"].withColumn("colour", F.lit("x"))},
        given | {"judgements": given["judgements"].drop("hasBox")},
        {n: t for n, t in given.items() if n != "qs_criteria"},
        tables(spark, judgements=[]),
    ]
    for each in wrong:
        with pytest.raises(sinks.PackError):
            publish(each, path)
    with pytest.raises(sinks.PackError):
        publish(given, path, version="../p1")
    broken = given["qs_criteria"].unionByName(given["judgements"].select(*[F.raise_error(F.lit("lost")).cast("string").alias(c) for c in V.PACK_TABLES["qs_criteria"]]))
    with pytest.raises(Exception, match="lost"):
        publish(given | {"qs_criteria": broken}, path)
    assert os.listdir(tmp_path) == []


def test_changed_files_are_refused(spark, tmp_path):
    path = str(tmp_path / "p1")
    publish(tables(spark), path)
    part = glob.glob(f"{path}/judgements/part-*")[0]
    with open(part, "a") as f:
        f.write("more\n")
    crc = os.path.join(os.path.dirname(part), f".{os.path.basename(part)}.crc")
    os.path.exists(crc) and os.remove(crc)
    with pytest.raises(sinks.PackError, match="differ from the manifest"):
        sinks.read_pack(spark, path)


def test_rows_are_counted_while_cells_are_checked(spark, tmp_path, monkeypatch):
    def again(*_):
        raise AssertionError("the stored tables are read once more")

    monkeypatch.setattr(sinks, "_counted", again)
    assert publish(tables(spark), str(tmp_path / "p1")).first().counts == {"judgements": 2, "defect_boxes": 1, "qs_criteria": 0}
