"""Live tail: each line once, over triggers, restarts and cuts."""

import io
import random

from wardline.streaming import streams, tail


def test_lines_of_any_cut(monkeypatch):
    monkeypatch.setattr(tail, "CHUNK", 5)
    rng = random.Random(1)
    content = "".join("x" * rng.randrange(12) + "\n" for _ in range(60)).encode()
    want, at = [], 0
    for line in content.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    begin = want[7][0]
    for split in (1, 3, 10, 1000):
        got = [x for s in range(begin, len(content), split) for x in tail.lines_from(io.BytesIO(content), tail.Range("f", begin, s, min(s + split, len(content)), len(content)))]
        assert got == want[7:]
    assert tail.whole_lines(io.BytesIO(content + b"half"), 0, len(content) + 4) == len(content)
    assert tail.whole_lines(io.BytesIO(b"no end"), 0, 6) == 0


def test_each_line_once_while_files_grow(spark, tmp_path):
    logs, work = tmp_path / "logs", tmp_path / "work"
    logs.mkdir()

    def seen():
        out = streams.run_to_end(tail.live_tail(spark, str(logs), "*.log", split=4), str(work), "append")
        return sorted((r.file.rpartition("/")[2], r.line) for r in out.collect())

    (logs / "a.log").write_text("one\ntwo\nhal")
    (logs / "b.txt").write_text("not a log\n")
    assert seen() == [("a.log", "one"), ("a.log", "two")]
    with (logs / "a.log").open("a") as f:
        f.write("f\nthree é\r\n")
    (logs / "b.log").write_text("new\n")
    assert seen() == [("a.log", "half"), ("a.log", "one"), ("a.log", "three é"), ("a.log", "two"), ("b.log", "new")]
    assert len(seen()) == 5  # nothing new, another restart
    (logs / "b.log").write_text("a\n")  # begun anew, shorter
    assert ("b.log", "a") in seen() and len(seen()) == 6


def test_last_lines_keep_few(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "r.log").write_text("# head\n" + "".join(f"line {k}\n" for k in range(30)) + "# end\n")
    out = streams.run_to_end(tail.last_lines(tail.live_tail(spark, str(logs)), 3), str(tmp_path / "w"), "append").collect()
    assert [(r.marked, r.seen, r.lines) for r in out] == [(2, 30, ["line 27", "line 28", "line 29"])]


def test_many_small_files_share_tasks(tmp_path):
    for k in range(3000):
        (tmp_path / f"r{k}.log").write_text(f"line {k}\nhalf")
    reader = tail._Reader({"path": str(tmp_path), "glob": "*.log", "split": "4"})
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) <= 600 and sorted({b.num_rows for p in parts[:9] for b in reader.read(p)})[0] > 1
    assert sorted(x for p in parts for b in reader.read(p) for x in b["line"].to_pylist()) == sorted(f"line {k}" for k in range(3000))
