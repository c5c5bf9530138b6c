"""Lines from the ends of files on: ranges, growth, restarts, shorter files."""

import io
import json
import random

import pytest

from timberline.runtime import new_folder
from timberline.sources import journal, tailing
from timberline.sources.tailing import Range, TailReader, lines_of, whole


@pytest.mark.parametrize("share", [1, 2, 7, 1000])
def test_ranges_give_each_line_once(share, monkeypatch):
    monkeypatch.setattr(tailing, "STEP", 5)
    rng = random.Random(share)
    for _ in range(60):
        data = "".join(rng.choice(["a", "\n", "é", "bb", "long" * 9]) for _ in range(rng.randint(0, 40))).encode()
        f = io.BytesIO(data)
        end = whole(f, 0, len(data))
        assert end == data.rfind(b"\n") + 1
        begin = rng.choice([0, *[k + 1 for k, c in enumerate(data) if c == 10]])
        want, place = [], 0
        for line in data[:end].split(b"\n")[:-1]:
            want += [(place, line)] * (place >= begin)
            place += len(line) + 1
        assert [x for k in range(begin, end, share) for x in lines_of(f, Range("f", k, min(k + share, end), end))] == want


def test_offsets(tmp_path):
    (tmp_path / "a").write_text("1\n2\nhal")
    (tmp_path / ".hidden").write_text("x\n")
    r = TailReader({"path": str(tmp_path), "share": "2"})
    start = r.initialOffset()
    assert start == {"a": 4} and TailReader({"path": str(tmp_path / "none")}).initialOffset() == {}
    with open(tmp_path / "a", "a") as f:
        f.write("f\n3\n")
    (tmp_path / "b").write_text("new\n")
    end = r.latestOffset()
    assert end == {"a": 11, "b": 4}
    assert [x for p in r.partitions(start, end) for x in r.read(p)] == [("a", 4, "half"), ("a", 9, "3"), ("b", 0, "new")]
    (tmp_path / "a").write_text("9\n")
    (tmp_path / "b").unlink()
    again = r.latestOffset()
    assert again == {"a": 2} and [x for p in r.partitions(end, again) for x in r.read(p)] == [("a", 0, "9")]
    assert [x for p in r.partitions(again, again) for x in r.read(p)] == []
    with pytest.raises(ValueError):
        TailReader({"path": "x", "begin": "middle"})


def test_the_tail_of_a_journal_over_restarts(spark, tmp_path):
    """What was there is passed over; a stream stopped and started loses none and repeats none."""
    exports, out, state = tmp_path / "exports", new_folder(spark, "journal"), new_folder(spark, "state")
    exports.mkdir()
    record = lambda k, unit="x": json.dumps({"MESSAGE": f"m{k}", "_SYSTEMD_UNIT": unit, "__REALTIME_TIMESTAMP": "1700000000000000"}) + "\n"
    (exports / "one").write_text("".join(record(k) for k in range(20)) + record(20)[:9])

    def run():
        stream = journal.tail(spark, str(exports), own_unit="me").select("raw", "host")
        return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)

    q = run().trigger(processingTime="200 milliseconds").start()
    try:
        q.processAllAvailable()
        with open(exports / "one", "a") as f:
            f.write(record(20)[9:] + record(21) + record(99, "me"))
        q.processAllAvailable()
    finally:
        q.stop()
    with open(exports / "one", "a") as f:
        f.write("".join(record(k) for k in range(22, 40)))
    (exports / "two").write_text("".join(record(k) for k in range(40, 50)))
    for _ in range(2):
        q = run().start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    got = [bytes(r.raw).decode() for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(f"m{k}" for k in range(20, 50))
