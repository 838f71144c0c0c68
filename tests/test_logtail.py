"""A log that grows is read once, line by line."""

import pytest

from fleetlens.sources import logtail
from fleetlens.streaming import operators as st


@pytest.fixture
def follow(spark, tmp_path):
    logtail.register(spark)

    def run():
        stream = spark.readStream.format("log_tail").load(str(tmp_path / "logs"))
        st.write_available(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
        return sorted((r.log.rsplit("/", 1)[1], r.position, r.line) for r in spark.read.schema(logtail.SCHEMA).parquet(str(tmp_path / "out")).collect())

    (tmp_path / "logs").mkdir()
    return run


def test_a_log_appended_between_runs(follow, tmp_path):
    a, b = tmp_path / "logs" / "a.log", tmp_path / "logs" / "b.log"
    a.write_bytes(b"one\ntwo\r\nhal")
    b.write_bytes(b"")
    first = [("a.log", 0, "one"), ("a.log", 4, "two")]
    assert follow() == first
    with a.open("ab") as f:
        f.write(b"f\n\xc3\xa9t\xc3\xa9\n")
    b.write_bytes(b"x\n")
    second = [*first, ("a.log", 9, "half"), ("a.log", 14, "\u00e9t\u00e9"), ("b.log", 0, "x")]
    assert follow() == second
    assert follow() == second


def test_a_log_that_was_begun_anew(follow, tmp_path):
    a = tmp_path / "logs" / "a.log"
    a.write_bytes(b"old line\n")
    follow()
    a.write_bytes(b"new\n")
    assert [line for *_, line in follow()] == ["new", "old line"]


def test_lines_longer_than_a_read(spark, follow, tmp_path, monkeypatch):
    monkeypatch.setattr(logtail, "CHUNK", 7)
    long = "y" * 1000
    (tmp_path / "logs" / "a.log").write_text(f"{long}\nshort\n{long}")
    size = (tmp_path / "logs" / "a.log").stat().st_size
    path = str(tmp_path / "logs")
    log = str(tmp_path / "logs" / "a.log")
    assert logtail.whole_lines(path, log, 0, size) == 1007
    assert [line for *_, line in logtail.read_part(path, logtail.Part(log, 0, size))] == [long, "short", long]
    assert [r.line for r in spark.read.format("log_tail").load(path).collect()] == [long, "short", long]
