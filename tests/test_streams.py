"""Followed files, debouncing and live changes: restarts and failures lose and repeat nothing."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner import graph_index
from gleaner.streaming import debounce, events, followed, live


def lines_of(spark, folder, state, out, **options):
    spark.dataSource.register(followed.FollowedLines)
    source = spark.readStream.format("followed_lines").option("path", f"file://{folder}").option("ledger", f"file://{state}/ledger")
    stream = source.options(**{k: str(v) for k, v in options.items()}).load()
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{state}/stream").start(str(out))
    q.processAllAvailable()
    q.stop()
    return sorted(tuple(r) for r in spark.read.schema("file string, at long, line string").parquet(str(out)).collect())


def test_appended_lines_are_read_once_over_restarts(spark, tmp_path):
    folder, wrote = tmp_path / "logs", {}
    folder.mkdir()

    def append(name, *lines, end="\n"):
        with open(folder / name, "ab") as f:
            for n, line in enumerate(lines):
                wrote.setdefault(f"{folder}/{name}", []).append((f.tell(), line))
                f.write(line.encode() + (end if n == len(lines) - 1 else "\n").encode())

    def want():
        return sorted((file, at, line) for file, rows in wrote.items() for at, line in rows)

    append("a.log", "one", "", "thrée " * 30_000, *(f"line {i}" for i in range(3000)))
    append("b.log", "x")
    assert lines_of(spark, folder, tmp_path / "s", tmp_path / "out", max_bytes=9000) == want()
    append("a.log", "more")
    append("b.log", "not yet whole", end="")
    got = lines_of(spark, folder, tmp_path / "s", tmp_path / "out", max_bytes=9000)
    assert got == [r for r in want() if r[2] != "not yet whole"]
    with open(folder / "b.log", "ab") as f:
        f.write(b"\n")
    append("c.log", "new file")
    assert lines_of(spark, folder, tmp_path / "s", tmp_path / "out") == want()
    (folder / "c.log").write_text("sh\n")  # it shrank: read from its start
    assert lines_of(spark, folder, tmp_path / "s", tmp_path / "out") == sorted([*want(), (f"{folder}/c.log", 0, "sh")])
    assert followed.dropped(f"file://{tmp_path}/s/ledger") == 0 and len(followed.Ledger(f"file://{tmp_path}/s/ledger").numbers()) <= followed.KEPT + 1


def test_ranges_of_a_file_share_no_line(tmp_path, monkeypatch):
    monkeypatch.setattr(followed, "RANGE", 7)
    monkeypatch.setattr(followed, "STEP", 5)
    text = b"ab\n\n\nlonger than a range\nc\n" * 3
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x").write_bytes(text)
    reader = followed.LineReader({"path": f"file://{tmp_path}/f", "ledger": f"file://{tmp_path}/l"})
    end = reader.latestOffset()
    parts = reader.partitions({"n": 0}, end)
    assert len(parts) > 3 and [line for p in parts for _, _, line in reader.read(p)] == text.decode().split("\n")[:-1]
    assert reader.latestOffset() == end


def test_overflow_is_counted(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    lines = [f"{i:09d}" for i in range(1000)]
    (tmp_path / "logs" / "a").write_text("\n".join(lines) + "\n")
    got = lines_of(spark, tmp_path / "logs", tmp_path / "s", tmp_path / "out", max_bytes=1000, overflow="drop")
    lost = followed.dropped(f"file://{tmp_path}/s/ledger")
    assert len(got) == 100 and lost == 9000
    with open(tmp_path / "logs" / "a", "a") as f:
        f.write("after\n")
    assert [r[2] for r in lines_of(spark, tmp_path / "logs", tmp_path / "s", tmp_path / "out", max_bytes=1000, overflow="drop")][-1] == "after"


def test_events_of_files(tmp_path):
    folder = tmp_path / "f"
    (folder / "sub").mkdir(parents=True)
    (folder / "a").write_text("1")
    (folder / "sub" / "b").write_text("2")
    reader = followed.EventReader({"path": f"file://{folder}", "ledger": f"file://{tmp_path}/l", "max_events": "2"})

    def polled(start):
        end = reader.latestOffset()
        return end, [(os.path.basename(p), op) for part in reader.partitions(start, end) for p, op, *_ in reader.read(part)]

    at, got = polled({"n": 0})
    assert sorted(got) == [("a", "create"), ("b", "create")]
    assert polled(at) == (at, [])
    (folder / "a").write_text("11")
    (folder / "sub" / "b").unlink()
    (folder / "c").write_text("3")
    at, first = polled(at)
    restarted = followed.EventReader(reader.options)
    end = restarted.latestOffset()
    rest = [(os.path.basename(p), op) for part in restarted.partitions(at, end) for p, op, *_ in restarted.read(part)]
    assert len(first) == 2 and sorted(first + rest) == [("a", "modify"), ("b", "delete"), ("c", "create")]


def test_debouncing_a_stream_equals_the_batch(spark, small, tmp_path):
    all_events = spark.read.parquet(f"{small}/events.parquet").filter("user_id < 40")
    want = events.debounced(all_events)
    want = sorted((r.key, int(pd.Timestamp(r.first).value // 1000), int(pd.Timestamp(r.last).value // 1000), r.operation, r.merged) for r in want.collect())
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    cuts = all_events.selectExpr("percentile(unix_micros(cast(ts as timestamp)), array(0.3, 0.31, 0.7)) AS p").first().p
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    held = [sum(((micros >= c).cast("int") for c in cuts), F.lit(0)) == k for k in range(4)]

    def run():
        stream = spark.readStream.schema(all_events.schema).parquet(source)
        q = debounce.debounced_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(out)
        q.awaitTermination()

    for part in held:  # a run for each: the stream is stopped and started again in between
        all_events.filter(part).write.mode("append").parquet(source)
        run()
    early = spark.read.parquet(out).count()
    late = all_events.selectExpr("max(ts) + interval 9 hours AS ts").first()[0]
    end = spark.createDataFrame([(None, late, None, None, None, None)], all_events.schema)
    end.select(*all_events.columns).write.mode("append").parquet(source)
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("key", "first", "last", "operation", "merged").collect())
    assert got == want and 0 < early < len(want)


def test_an_interrupted_stream_of_changes_gives_the_graph_of_a_build(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    spark.dataSource.register(followed.FileEvents)
    files = lambda: spark.createDataFrame([(str(p), p.read_text()) for p in sorted(root.iterdir())], "path string, content string")
    (root / "m0.py").write_text("x = 0\n")
    graph_index.build(f"file://{tmp_path}/broken", files())
    seen = {"fail": True}

    def follow(name, breaks=False):
        def step(before, changed, removed):
            g = graph_index.GraphIndex(spark, f"file://{tmp_path}/{name}", before)
            graph_index.change(g, changed, removed)
            if breaks and before == 0 and seen.pop("fail", False):
                raise RuntimeError("killed after the change was written, before the batch was done")

        state = f"{tmp_path}/state-{name}"
        stream = spark.readStream.format("file_events").option("path", f"file://{root}").option("ledger", f"file://{state}/ledger").load()
        live.run(stream, live.applied(live.base_of(spark, f"file://{state}", 0), live.file_contents(f"file://{root}"), step), state)

    for k in range(1, 4):
        (root / f"m{k}.py").write_text(f"import m{k - 1}\nfrom m{k + 1} import x\n")
    (root / "n.md").write_text("see `m9.py`\n")
    with pytest.raises(Exception, match="killed"):
        follow("broken", True)
    (root / "m0.py").unlink()
    (root / "m1.py").write_text("import m3\n")
    follow("broken", True)
    assert "fail" not in seen
    last = lambda name: max(int(p.name.split("=")[1]) for p in (tmp_path / name / "paths" / "rows").iterdir() if "=" in p.name)
    rows = lambda name: sorted(map(str, graph_index.GraphIndex(spark, f"file://{tmp_path}/{name}", last(name)).links().collect()))
    fresh = graph_index.build(f"file://{tmp_path}/fresh", files())
    assert rows("broken") == sorted(map(str, fresh.links().collect())) and len(rows("broken")) > 3
