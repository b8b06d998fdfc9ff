from __future__ import annotations

import json
import struct

from pyspark.sql import functions as F

from quillspark.sources import readers
from quillspark.streaming import attempts as stream


def webp(tag, body):
    data = b"RIFF" + struct.pack("<I", 4) + b"WEBP" + tag + struct.pack("<I", len(body)) + body
    return data + b"\0" * 30


def test_image_sizes(spark, tmp_path):
    lossy = webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 1150 | 0x4000, 300))
    lossless = webp(b"VP8L", b"\x2f" + struct.pack("<I", (640 - 1) | (480 - 1) << 14))
    extended = webp(b"VP8X", b"\0" * 4 + (1999).to_bytes(3, "little") + (99).to_bytes(3, "little"))
    for name, data in {"a": lossy, "b": lossless, "c": extended, "d": b"no image" * 9}.items():
        (tmp_path / f"{name}.webp").write_bytes(data)
    got = {r["path"][-6]: (r["width"], r["height"]) for r in readers.images(spark, str(tmp_path)).collect()}
    assert got == {"a": (1150, 300), "b": (640, 480), "c": (2000, 100), "d": (None, None)}


def test_states_of_both_versions(spark):
    old = {"v": 1, "respostas": {"2021-x-q1": [{"r": "A", "ok": True, "t": 1000, "m": "study", "ms": 5}]}, "marcadas": {}}
    new = {"version": 2, "attempts": {"2021-y-q2": [{"choice": "B", "ok": None, "at": 2000, "mode": "mock", "ms": 7}, {"choice": "C", "ok": False, "at": 3000, "mode": "mock", "ms": 7}]}}
    states = spark.createDataFrame([("o", json.dumps(old)), ("n", json.dumps(new)), ("e", "{}"), ("b", "not json"), ("z", None)], "user string, body string")
    got = sorted((r["user"], r["question"], r["choice"], r["ok"], r["seq"]) for r in readers.study_attempts(states, "user", "body", {"-x-": "-z-"}).collect())
    assert got == [("n", "2021-y-q2", "B", None, 0), ("n", "2021-y-q2", "C", False, 1), ("o", "2021-z-q1", "A", True, 0)]


def test_lookup_and_warnings(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"exam_id": "e", "num": 1, "answer": null}\n')
    keys = readers.lookup(spark, str(tmp_path / "k.json"), "exam_id string, num int, answer string")
    questions = spark.createDataFrame([("e", 1), ("e", 3), ("e", 2)], "exam_id string, num int")
    assert [tuple(r) for r in readers.warnings(questions, keys, ["exam_id", "num"]).collect()] == [("e", 2, [2, 3])]


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT 'u' AS user, 'q' AS question, true AS ok, timestamp'2024-01-01 10:00:00' AS at, 1L AS seq UNION ALL SELECT 'u', 'q', false, timestamp'2024-01-01 11:00:00', 2L UNION ALL SELECT 'u', 'p', true, timestamp'2024-01-03 11:00:00', 3L")
    rows.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    stream.keep_latest(stream.clean(source()), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r["question"], r["ok"]) for r in stream.read_latest(spark, str(tmp_path / "out")).collect()} == {("q", False), ("p", True)}
    more = spark.sql("SELECT 'u' AS user, 'q' AS question, true AS ok, timestamp'2024-01-03 12:00:00' AS at, 4L AS seq UNION ALL SELECT 'u', 'p', false, timestamp'2024-01-03 10:30:00', 5L")
    more.write.mode("append").parquet(str(tmp_path / "in"))
    stream.keep_latest(stream.clean(source()), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r["question"], r["ok"]) for r in stream.read_latest(spark, str(tmp_path / "out")).collect()} == {("q", True), ("p", True)}
    q = stream.daily_activity(source()).writeStream.format("memory").queryName("days").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(str(r["day"]), r["n"], r["right"]) for r in spark.table("days").collect()][:1] == [("2024-01-01", 2, 1)]
