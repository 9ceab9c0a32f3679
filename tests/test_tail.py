"""Tailed files: append, half lines, rotation, truncation, restart; alert files that rotate."""

import json
import os

from logsight.sources import sinks, tail


class Drain:
    def __init__(self, spark, folder, checkpoint):
        self.spark, self.folder, self.checkpoint = spark, folder, checkpoint

    def __call__(self):
        """What a restarted stream finds."""
        out = []
        rows = tail.tail_lines(self.spark, f"{self.folder}/*.log*")
        query = rows.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", self.checkpoint).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((os.path.basename(r.source_id), r.position, r.value) for r in out)


def test_tailing(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    log = folder / "a.log"
    drain = Drain(spark, folder, str(tmp_path / "checkpoint"))
    log.write_bytes(b"one\r\ntwo\nhal")
    assert drain() == [("a.log", 0, "one"), ("a.log", 5, "two")]
    assert drain() == []
    with log.open("ab") as f:  # the rest of the half line, a blank one, one with NUL, one too long, and a half one
        f.write(b"f\n  \nbad\x00\n" + b"x" * 70_000 + b"\n\xc3\xa9 fin")
    assert [v for _, _, v in drain()] == ["half"]
    with log.open("ab") as f:
        f.write(b"\n")
    assert [v for _, _, v in drain()] == ["é fin"]
    # rotated with a last line, and a new file under the old name
    with log.open("ab") as f:
        f.write(b"last of old\n")
    log.rename(folder / "a.log.1")
    log.write_bytes(b"first of new\n")
    assert [(n, v) for n, _, v in drain()] == [("a.log", "first of new"), ("a.log.1", "last of old")]
    # truncated
    log.write_bytes(b"cut\n")
    assert drain() == [("a.log", 0, "cut")]
    (folder / "a.log.1").unlink()
    (folder / "b.log").write_bytes(b"other\n")
    assert drain() == [("b.log", 0, "other")]


def test_parts_of_a_file_share_no_line(tmp_path, monkeypatch):
    path = tmp_path / "big.log"
    lines = [f"line {i} " + "y" * (i % 17) for i in range(500)]
    path.write_text("\n".join(lines) + "\nhalf")
    size, inode = path.stat().st_size, str(path.stat().st_ino)
    for part in (1, 7, 64, 1000, 1 << 20):
        monkeypatch.setattr(tail, "PART", part)
        reader = tail._TailReader({"path": str(path)})
        for start in (0, 13, 600):
            found = [v for p in reader.partitions({"files": {inode: start}}, {"files": {inode: size}}) for b in reader.read(p) for v in b.column("value").to_pylist()]
            done = path.read_bytes()[:start].count(b"\n")
            assert found == lines[done:]


def test_alert_files_rotate(spark, tmp_path):
    rows = [(f"a{i:03d}", i * 10, i % 5, "x" * (i % 30)) for i in range(200)]
    schema = "alert_id string, timestamp_ns long, severity_id int, note string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    alerts = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = tmp_path / "out"
    sinks.rotating_alert_sink(alerts, str(out), str(tmp_path / "c"), floor=1, max_bytes=1000, every_ns=1000).awaitTermination()
    files = sorted(out.rglob("part-*"))
    found = []
    for f in files:
        own = [json.loads(x) for x in f.read_text().splitlines()]
        assert f.stat().st_size <= 1000 + 120 and len({x["timestamp_ns"] // 1000 for x in own}) == 1
        found += own
    assert len(files) > 8
    assert sorted((x["alert_id"], x["note"]) for x in found) == sorted((i, n) for i, _, s, n in rows if s >= 1)
