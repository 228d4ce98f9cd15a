import json
import shutil

import pytest
from pyspark.sql import functions as F

from strandline.sources import diagnose, readers, writers
from strandline.streaming import checkpoints


def test_register_keeps_codes(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿JASID,LGC,Unnamed: 12\n1,00123,x\n2,,y\n", encoding="utf-8")
    frame = readers.read_register(spark, str(tmp_path / "r.csv"))
    assert frame.columns == ["JASID", "LGC"] and [r.LGC for r in frame.collect()] == ["00123", None]
    assert readers.resolve_column(frame, ["lgc"]) == "LGC" and readers.resolve_column(frame, ["x"], "^jas") == "JASID"
    assert readers.with_missing(frame, ["LGC", "Name"]).columns == ["JASID", "LGC", "Name"]


def test_encodings_and_twin(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("名,値\n縄文,1\n".encode("cp932"))
    (tmp_path / "b.csv").write_bytes("名\n".encode("utf-8-sig"))
    (tmp_path / "c.csv").write_bytes(b"a\x81")
    got = {r.path.rsplit("/", 1)[1]: (r.encoding, r.bom) for r in readers.sniff_encodings(readers.binary_files(spark, str(tmp_path))).collect()}
    assert got == {"a.csv": ("cp932", False), "b.csv": ("utf-8-sig", True), "c.csv": ("unknown", False)}
    assert readers.read_register(spark, str(tmp_path / "a.csv"), encoding="cp932").first()["名"] == "縄文"
    writers.write_csv(spark.createDataFrame([("縄文", None)], "a string, b string"), str(tmp_path / "out"), "windows-31j")
    assert readers.read_register(spark, str(tmp_path / "out"), encoding="cp932").first().a == "縄文"


def test_checkpoint(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"uid":"a","n":1}\nbroken{\n{"uid":"a","n":2}\n{"n":5}\n{"uid":"b","n":1}\n')
    got = readers.read_checkpoint(spark, str(tmp_path / "c.jsonl"), "uid string, n int", "uid", ["n"])
    assert sorted((r.uid, r.n) for r in got.collect()) == [("a", 2), ("b", 1)]
    writers.append(spark.createDataFrame([("b", 9)], "uid string, n int"), str(tmp_path / "log"))
    writers.append(spark.createDataFrame([("c", 1)], "uid string, n int"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    features = [
        {"properties": {"code": "10101"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"CODE": "5"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
        {"properties": {}, "geometry": {"type": "Point", "coordinates": [0, 0]}},
    ]
    (tmp_path / "t.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = readers.read_geojson(spark, str(tmp_path / "t.geojson")).collect()
    assert sorted(r.landform_code for r in rows) == ["10101", "5", "5"] and rows[0].rings[0][1].x == 1.0


def test_json_helpers(spark):
    f = spark.createDataFrame([('{"id":"7","name":" ","title":"T"}', '[{"label":"a","value":"1"},{"label":null,"value":"2"}]', '{"result":{"item":{"x":3}}}')], "t string, p string, w string")
    fields = readers.json_fields(F.col("t"), {"key": ["uid", "id"], "name": ["name", "title"]})
    r = f.select(fields.alias("f"), readers.label_values(F.col("p")).alias("l"), readers.unwrap(F.col("w"), "$.data.x", "$.result.item.x").alias("u")).first()
    assert r.f == {"key": "7", "name": "T"} and r.l == {"a": "1"} and r.u == "3"


def test_splits(spark, tmp_path):
    f = spark.createDataFrame([(1, "13", 1, 1, 0), (2, "14", 0, 1, 0)], "id int, LGC string, Pa int, Jo int, Ya int")
    counts = {r.flag: r.n_rows for r in writers.write_by_flags(f, ["Pa", "Jo", "Ya"], str(tmp_path / "age")).collect()}
    assert counts == {"Pa": 1, "Jo": 2, "Ya": 0}
    assert spark.read.option("header", True).csv(str(tmp_path / "age")).count() == 3
    master = spark.createDataFrame([("13", "Kita"), ("14", "Minami")], "LGC string, roman string")
    writers.write_by_key(f, master, "LGC", "roman", str(tmp_path / "unit"))
    assert {p.name for p in (tmp_path / "unit").glob("unit=*")} == {"unit=13_Kita", "unit=14_Minami"}
    with pytest.raises(ValueError):
        writers.write_by_key(f, spark.createDataFrame([("13", "a/b")], "LGC string, roman string"), "LGC", "roman", str(tmp_path / "bad"))


def test_replace_and_audit(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.replace(spark.range(3).toDF("n"), path) is None
    backup = writers.replace(spark.range(5).toDF("n"), path)
    assert spark.read.parquet(path).count() == 5 and spark.read.parquet(backup).count() == 3
    assert writers.restore(spark, path) is None  # something stands there
    shutil.rmtree(path)
    assert writers.restore(spark, path).endswith(backup) and spark.read.parquet(path).count() == 3
    found = {r.name: r.found for r in writers.output_audit(spark, ["t", "gone"], str(tmp_path)).collect()}
    assert found == {"t": True, "gone": False}
    assert writers.template(spark, "a int, b string").columns == ["a", "b"]


def test_diagnostics(spark):
    files = [
        ("ok.csv", b"JASID,Lon,Lat\n1,139.5,35.5\n"),
        ("bad.csv", b"JASID,Lon,Lat,Lon\r\n1,x,95,1\n2,,inf,2\n3,1\n\n4\x00,181,1,1\n"),
        ("sjis.csv", "JASID,Lon,Lat\n縄,1,1\n".encode("cp932")),
        ("junk.csv", b"a\x81"),
        ("none.csv", b""),
    ]
    got = {}
    for r in diagnose.inspect(spark.createDataFrame(files, "path string, content binary"), ["JASID", "LGC"]).collect():
        got.setdefault(r.path, set()).add(r.category)
    assert got["ok.csv"] == {"missing_column"}
    assert got["bad.csv"] == {"missing_column", "nul_byte", "line_ending", "header", "coordinate_not_numeric", "coordinate_out_of_range", "coordinate_missing", "column_count", "blank_record"}
    assert got["sjis.csv"] == {"encoding", "missing_column"} and got["junk.csv"] == {"encoding"} and got["none.csv"] == {"empty"}


def test_stream_takes_each_key_once(spark, tmp_path):
    schema = "uid string, ts timestamp, n int"
    make = lambda rows: spark.createDataFrame(rows, "uid string, ts string, n int").withColumn("ts", F.to_timestamp("ts"))
    make([("a", "2026-01-01 00:00:00", 1), ("b", "2026-01-01 00:01:00", 1)]).write.parquet(str(tmp_path / "in"))
    go = lambda: checkpoints.to_table(checkpoints.first_of_key(checkpoints.read_records(spark, str(tmp_path / "in"), schema), "uid", "ts"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    make([("a", "2026-01-01 01:00:00", 2), ("c", "2026-01-01 01:00:00", 1)]).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert sorted((r.uid, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 1), ("c", 1)]
    counts = checkpoints.windowed_counts(spark.read.parquet(str(tmp_path / "in")), "ts", "uid")
    assert counts.count() == 3


def test_csv_files_hold_every_order(spark):
    from strandline.plans import quality
    from tests.conftest import SF

    texts = [bytes(r.content).decode().splitlines() for r in quality._files(spark, SF).collect()]
    keys = [int(line.split(",")[0]) for t in texts for line in t[1:]]
    assert sorted(keys) == sorted(r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect())
    assert max(map(len, texts)) <= quality._SPAN + 1
