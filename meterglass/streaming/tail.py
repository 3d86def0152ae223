"""Growing files as a stream: a Python data source that reads only what was appended.

The offset says of each file how far it is read, its size and mtime when seen, and its life: the
time at which what is read of it began. A file that shrank begins a new life and is read from 0
again. On the first batch files older than the look-back start at their end, younger ones at 0;
``from_zero`` marks rows of a life that was read from 0, ``epoch`` is the life, so (epoch, start)
orders a file's rows. The listing runs on the driver (see ``scan``), reading in tasks: growth is cut
in pieces of ``PIECE`` bytes wherever that falls, as a line counts to the piece in which it ends. A
last line without a newline counts as soon as it is complete JSON, and never again when its newline
follows.

With ``batch_bytes`` a batch holds about that much growth: files share it evenly, what doesn't fit
waits, and files that have waited longest come first. Where the last batch ended is noted in the
folder ``progress`` before it is handed out, so after a restart the bound holds, too; without it the
first batch after a restart takes all growth. Under ``availableNow`` a run takes one such batch.

Options: path (a folder, any store that pyarrow opens), suffix, lookback_ms (6 hours), batch_bytes,
progress, full_ms (a whole walk at least each minute), now_ms (the clock, for replays, which walk
whole each time unless full_ms says otherwise).
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, replace
from hashlib import sha256

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources import listing
from . import scan

SCHEMA = "file string, epoch long, start long, from_zero boolean, mtime_ms long, value string"
LOOKBACK_MS = 6 * 3600 * 1000
#: Bytes read at once when looking back for the start of a line.
BACK = 1 << 16
#: Bytes of growth read at once; beyond them only an unfinished line is held.
STEP = 1 << 20
#: Bytes of one file's growth that a task reads.
PIECE = 16 << 20
#: Ranges that each get a task; of more, small ones share tasks.
TASKS = 64
#: The least share of a bounded batch that a file gets.
SHARE = 1 << 16


@dataclass
class Range(InputPartition):
    file: str
    epoch: int
    start: int
    end: int
    from_zero: bool
    mtime_ms: int


@dataclass
class Ranges(InputPartition):
    """Small ranges that one task reads."""

    each: list[Range]


def dealt(ranges: list[Range]) -> list[Range | Ranges]:
    """Of more than ``TASKS`` ranges those that are next to each other share tasks, up to ``PIECE`` bytes: a task costs more than a small file."""
    if len(ranges) <= TASKS:
        return ranges
    most, out, size = min(PIECE, sum(r.end - r.start for r in ranges) // TASKS), [], 0
    for r in ranges:
        if not out or size + r.end - r.start > most:
            out.append([])
            size = 0
        out[-1].append(r)
        size += r.end - r.start
    return [some[0] if len(some) == 1 else Ranges(some) for some in out]


@dataclass(frozen=True)
class Place:
    """How far a file is read, and what it looked like. A life of 0: that of the place before, which isn't known here."""

    end: int
    mtime: int
    size: int
    life: int = 0
    from_zero: bool = False


def after(at: Place | None, size: int, mtime: int) -> Place:
    """The place from which a file of this size goes on: a new one and one that shrank begin."""
    if at is None:
        return Place(0, mtime, size, max(mtime, 1), True)
    if size < at.size:
        return Place(0, mtime, size, max(mtime, at.life + 1), True)
    return replace(at, mtime=mtime, size=size)


def shared(grown: list[tuple[int, str, int]], room: int | None) -> dict[str, int]:
    """Bytes that each file gives to a batch: (mtime, file, growth) of all files, the least recent first."""
    if room is None:
        return {f: n for _, f, n in grown}
    out, fair = {}, max(SHARE, room // max(1, len(grown)))
    for _, f, n in sorted(grown):
        if room <= 0:
            break
        out[f] = min(n, fair)
        room -= out[f]
    for _, f, n in sorted(grown):  # what small growths left over
        if room <= 0:
            break
        more = min(n - out.get(f, 0), room)
        out[f] = out.get(f, 0) + more
        room -= more
    return out


file_system = listing.store


def complete(piece: bytes) -> bool:
    """Whether a line without its newline is a whole JSON value."""
    try:
        json.loads(piece)
    except ValueError:
        return False
    return True


def grown_lines(read, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(place, line) of the lines that end within (start, end]. ``read(a, b)`` gives bytes a..b."""
    first = start
    while first > 0:
        a = max(0, first - BACK)
        piece = read(a, first)
        cut = piece.rfind(b"\n")
        if cut >= 0:
            first = a + cut + 1
            break
        first = a
    # a line that ended at ``start`` without its newline was counted then
    told = first < start and complete(read(first, start))
    at, held, pos = first, [], first
    while pos < end:
        piece = read(pos, min(end, pos + STEP))
        if not piece:
            break
        pos += len(piece)
        head, *rest = piece.split(b"\n")
        held.append(head)
        for after in rest:
            line = b"".join(held)
            if not (told and at == first):
                yield at, line
            at, held = at + len(line) + 1, [after]
    last = b"".join(held)
    if last.strip() and complete(last) and not (told and at == first):
        yield at, last


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffix = options.get("suffix", "")
        self.lookback = int(options.get("lookback_ms", LOOKBACK_MS))
        self.now = options.get("now_ms")
        self.room = int(options["batch_bytes"]) if "batch_bytes" in options else None
        self.progress = options.get("progress")
        full = int(options.get("full_ms", 0 if self.now else scan.FULL_MS))
        self.scan = scan.TieredScan(self.path, listing.patterns(f"*{self.suffix}"), full)
        self.last: dict[str, Place] | None = None
        self.initial: dict[str, Place] | None = None

    def __getstate__(self) -> dict:
        """What tasks need: not the driver's view of the tree."""
        return {**self.__dict__, "scan": None, "last": None, "initial": None}

    def clock(self) -> int:
        return int(self.now) if self.now else int(time.time() * 1000)

    def files(self) -> dict[str, tuple[int, int]]:
        return self.scan.files(self.clock())

    def cold(self, found: dict[str, tuple[int, int]]) -> dict[str, Place]:
        """The ends of old files: all others are read from 0."""
        oldest = self.clock() - self.lookback
        return {f: Place(size, mtime, size, max(mtime, 1), size == 0) for f, (size, mtime) in found.items() if mtime < oldest}

    def initialOffset(self) -> dict:
        if self.initial is None:  # Spark asks for the latest offset first
            self.initial = self.cold(self.files())
        return told(self.initial)

    def latestOffset(self) -> dict:
        found = self.files()
        before = self.last if self.last is not None else self.noted()
        if before is None and self.progress:
            before = self.initial = self.cold(found)
        if before is None:  # a first batch, or a restart without a note: all growth, in lives that ``partitions`` can tell
            self.last = {f: Place(size, mtime, size) for f, (size, mtime) in found.items()}
            return told(self.last)
        at = {f: after(before.get(f), size, mtime) for f, (size, mtime) in found.items()}
        give = shared([(p.mtime, f, p.size - p.end) for f, p in at.items() if p.size > p.end], self.room)
        now = {f: replace(p, end=p.end + give.get(f, 0)) for f, p in at.items()}
        if now != self.last:
            self.note(now)
        self.last = now
        return told(now)

    def note_file(self) -> str:
        return f"{self.progress.rstrip('/')}/{sha256(f'{self.path}|{self.suffix}'.encode()).hexdigest()[:16]}.json"

    def noted(self) -> dict[str, Place] | None:
        """Where the last batch that was handed out ends. Never behind the query's own offset."""
        if not self.progress:
            return None
        store, at = listing.store(self.note_file())
        try:
            with store.open_input_stream(at) as f:
                return places(json.loads(f.read()))
        except FileNotFoundError:
            return None

    def note(self, now: dict[str, Place]) -> None:
        if not self.progress:
            return
        store, at = listing.store(self.note_file())
        store.create_dir(at.rpartition("/")[0])
        with store.open_output_stream(f"{at}.new") as f:
            f.write(json.dumps(told(now)).encode())
        store.move(f"{at}.new", at)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out, before, known = [], places(start), {}
        for f, place in sorted(places(end).items()):
            had = before.get(f)
            begin = after(had, place.size, place.mtime)
            if place.life and (had is None or begin.life == had.life or not had.life):
                begin = replace(begin, life=place.life, from_zero=place.from_zero)
            known[f] = replace(begin, end=place.end)
            for a in range(begin.end, place.end, PIECE):
                out.append(Range(f, begin.life, a, min(a + PIECE, place.end), begin.from_zero, place.mtime))
        if self.last is not None and told(self.last) == end:
            if known != self.last:
                self.note(known)
            self.last = known
        return dealt(out)

    def read(self, partition: Range | Ranges) -> Iterator[tuple]:
        store, _ = file_system(self.path)
        for part in partition.each if isinstance(partition, Ranges) else [partition]:
            yield from self.read_range(store, part)

    def read_range(self, store, partition: Range) -> Iterator[tuple]:
        try:
            f = store.open_input_file(partition.file)
        except FileNotFoundError:  # gone since it was listed
            return
        with f:

            def read(a: int, b: int) -> bytes:
                f.seek(a)
                return f.read(b - a)

            for at, line in grown_lines(read, partition.start, partition.end):
                try:
                    text = line.decode("utf-8").rstrip("\r")
                except UnicodeDecodeError:
                    continue
                yield partition.file, partition.epoch, at, partition.from_zero, partition.mtime_ms, text


def told(at: dict[str, Place]) -> dict:
    return {f: [p.end, p.mtime, p.size, p.life, p.from_zero] for f, p in at.items()}


def places(offset: dict) -> dict[str, Place]:
    return {f: Place(*p) for f, p in offset.items()}


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines").option("path", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(GrowingLines)
