"""Streaming sources that follow a folder: lines appended to its files, and events of files that came, changed or went.

Each poll is written to a ledger (a folder of small JSON files that the driver and a restarted driver share) before its
rows are handed out: what it takes of each file, and where the next poll begins. An offset is a number in the ledger, so a
restart plans the same rows for the same batch, and a poll that was written but not yet run is run with the next one:
nothing is lost or repeated. A poll admits `max_bytes` or `max_events`; the rest waits, or, with overflow = drop, is
skipped and counted in the ledger, so that a reader that falls behind catches up.

    spark.dataSource.register(FollowedLines); spark.dataSource.register(FileEvents)
    spark.readStream.format("followed_lines").option("path", folder).option("ledger", ledger).load()     # file, at, line
    spark.readStream.format("file_events").option("path", folder).option("ledger", ledger).load()        # path, op, at, bytes

A line counts once its line end is there. A file that shrank is read from its start; lines of any length are whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes that a task reads of a file; bytes looked through at a time for a line end; rows of a task; what a poll admits by default.
RANGE, STEP, EVENTS = 8 << 20, 1 << 16, 10_000
MAX_BYTES, MAX_EVENTS = 256 << 20, 100_000
#: Entries that stay in the ledger after the last one that a batch finished with.
KEPT = 2


class Ledger:
    """Numbered entries in a folder; each appears whole or not at all."""

    def __init__(self, place: str):
        self.files, self.at = fs.FileSystem.from_uri(place)
        self.files.create_dir(self.at, recursive=True)

    def numbers(self) -> list[int]:
        names = (f.base_name for f in self.files.get_file_info(fs.FileSelector(self.at)))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def read(self, n: int) -> dict:
        with self.files.open_input_stream(f"{self.at}/{n}.json") as f:
            return json.loads(f.read())

    def last(self) -> tuple[int, dict]:
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else (0, {"state": {}, "plan": [], "dropped": 0})

    def append(self, n: int, entry: dict) -> None:
        with self.files.open_output_stream(f"{self.at}/{n}.tmp") as f:
            f.write(json.dumps(entry).encode())
        self.files.move(f"{self.at}/{n}.tmp", f"{self.at}/{n}.json")

    def prune(self, done: int) -> None:
        for n in self.numbers()[:-1]:
            if n <= done - KEPT:
                self.files.delete_file(f"{self.at}/{n}.json")


def dropped(place: str) -> int:
    """What overflow has skipped so far: bytes of lines, or events."""
    return Ledger(place).last()[1]["dropped"]


class _Part(InputPartition):
    def __init__(self, rows: list):
        self.rows = rows


class _Poller(DataSourceStreamReader):
    """Offsets by the ledger; what a poll takes is up to the kind of source."""

    def __init__(self, options: dict):
        self.place, self.ledger_at = options["path"], options["ledger"]
        self.drops = options.get("overflow", "wait") == "drop"
        self.options = options

    def poll(self, state: dict) -> tuple[list, dict, int]:
        """(plan, next state, dropped) of what is new since `state`."""
        raise NotImplementedError

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        ledger = Ledger(self.ledger_at)
        n, entry = ledger.last()
        plan, state, lost = self.poll(entry["state"])
        if plan or lost:
            n += 1
            ledger.append(n, {"state": state, "plan": plan, "dropped": entry["dropped"] + lost})
        return {"n": n}

    def planned(self, start: dict, end: dict) -> list:
        ledger = Ledger(self.ledger_at)
        return [p for n in range(start["n"] + 1, end["n"] + 1) for p in ledger.read(n)["plan"]]

    def commit(self, end: dict) -> None:
        Ledger(self.ledger_at).prune(end["n"])

    def listing(self) -> list[fs.FileInfo]:
        files, at = fs.FileSystem.from_uri(self.place)
        found = files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


class LineReader(_Poller):
    def poll(self, state: dict) -> tuple[list, dict, int]:
        files, _ = fs.FileSystem.from_uri(self.place)
        budget, plan, now, lost = int(self.options.get("max_bytes", MAX_BYTES)), [], {}, 0
        for f in self.listing():
            at = state.get(f.path, 0)
            at = 0 if f.size < at else at
            end = at
            if f.size > at and budget > 0:
                end = _line_end(files, f.path, at, min(f.size, at + budget), f.size)
            if end > at:
                plan.append([f.path, at, end])
                budget -= end - at
            if self.drops and budget <= 0 and f.size > end:
                last = _line_end(files, f.path, end, f.size, f.size)
                lost, end = lost + last - end, last
            now[f.path] = end
        return plan, now, lost

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part([file, s, min(s + RANGE, b)]) for file, a, b in self.planned(start, end) for s in range(a, b, RANGE)]

    def read(self, part: _Part) -> Iterator[tuple]:
        """The lines that begin in a range of a file; the last one may end beyond it."""
        file, a, b = part.rows
        files, _ = fs.FileSystem.from_uri(self.place)
        with files.open_input_file(file) as f:
            f.seek(max(0, a - 1))
            rest, at = b"", max(0, a - 1)  # at: of the first byte of `rest`
            skip = a > 0  # up to the first line end at a - 1 or after: it belongs to the range before
            while at < b or rest:
                more = f.read(STEP)
                lines = (rest + more).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if not skip:
                        if at >= b:
                            return
                        yield file, at, line.decode("utf-8", "replace")
                    skip, at = False, at + len(line) + 1
                if not more or at >= b:
                    return


def _line_end(files: fs.FileSystem, path: str, at: int, upto: int, size: int) -> int:
    """The place after the last line end before `upto`, or if there is none the first after it; `at` if no line ends."""
    with files.open_input_file(path) as f:
        hi = upto
        while hi > at:
            lo = max(at, hi - STEP)
            f.seek(lo)
            k = f.read(hi - lo).rfind(b"\n")
            if k >= 0:
                return lo + k + 1
            hi = lo
        f.seek(upto)
        place = upto
        while place < size and (piece := f.read(STEP)):
            k = piece.find(b"\n")
            if k >= 0:
                return place + k + 1
            place += len(piece)
    return at


class EventReader(_Poller):
    def poll(self, state: dict) -> tuple[list, dict, int]:
        there = {f.path: [f.mtime_ns or 0, f.size] for f in self.listing()}
        found = [[p, "modify" if p in state else "create", *v] for p, v in there.items() if state.get(p) != v]
        seen = max([v[0] for v in there.values()] + [v[0] for v in state.values()], default=0)
        found += [[p, "delete", seen, 0] for p in state if p not in there]
        found.sort(key=lambda e: (e[2], e[0]))
        most = int(self.options.get("max_events", MAX_EVENTS))
        plan, over = found[:most], found[most:]
        now = dict(state)
        for p, op, *v in plan + (over if self.drops else []):
            if op == "delete":
                now.pop(p)
            else:
                now[p] = v
        return plan, now, len(over) if self.drops else 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = self.planned(start, end)
        return [_Part(rows[k : k + EVENTS]) for k in range(0, len(rows), EVENTS)]

    def read(self, part: _Part) -> Iterator[tuple]:
        for path, op, ns, size in part.rows:
            yield path, op, datetime.fromtimestamp(ns / 1e9, UTC), size


class FollowedLines(DataSource):
    """file string, at long (the line's first byte), line string."""

    @classmethod
    def name(cls) -> str:
        return "followed_lines"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return LineReader(self.options)


class FileEvents(DataSource):
    """path string, op string (create, modify, delete), at timestamp (of the change; of the newest file for a deletion), bytes long."""

    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return "path string, op string, at timestamp, bytes long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return EventReader(self.options)
