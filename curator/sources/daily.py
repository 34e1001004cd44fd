"""Text files by day as a data source: ``spark.read.format("daily_texts")``, ``readStream`` and ``write``.

Rows are (day, name, text, commit). A write puts each text in a file of its own below its day's folder and, task by task, an index
of these files; only the commit file, written last by the driver, makes them visible. So a task or a write that
fails leaves nothing that a reader sees, and tasks that run again leave files that no commit names. Appending adds to
a day; overwriting replaces the days that are written and no others, so a re-run of a day replaces it. Commits count up, and
a stream's offset is the last one read.

The driver knows commits and, for each writing task, its index and its days, never single files: those are read where they are
needed. A filter on day or commit is pushed down: parts without such days are not planned, files of other days are not opened.
Paths are URIs of any file system that Arrow reads.

Edge cases: a null day or text is kept as such, a null name is empty; names with other characters than letters, digits,
dots and hyphens are kept in the index while the file is called after what remains; equal names stay apart; a folder without commits is empty.
"""

from __future__ import annotations

import datetime
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

FORMAT = "daily_texts"
SCHEMA = "day date, name string, text string, commit bigint"
#: Bytes of text in a batch of rows, about.
BATCH = 8 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _read(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_stream(path) as f:
        return f.read()


def _write(system: fs.FileSystem, path: str, data: bytes) -> None:
    with system.open_output_stream(path) as f:
        f.write(data)


@dataclass
class Part(D.InputPartition):
    """Files of one writing task: its index, the commit, and the days (as text, "" for null) that are still its own; all if None."""

    index: str
    commit: int
    days: list[str]


@dataclass
class Written(D.WriterCommitMessage):
    index: str
    days: list[str]
    files: int
    bytes: int


def commits(path: str) -> list[dict]:
    """The commits of a folder in their order: number, file, whether they replace days, their parts."""
    system, root = _opened(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    names = sorted(f.base_name for f in found if re.fullmatch(r"\d{12}-[0-9a-f]+\.json", f.base_name))
    return [{"commit": i + 1, "number": int(n[:12]), "file": n, **json.loads(_read(system, f"{root}/_commits/{n}"))} for i, n in enumerate(names)]


def visible(path: str) -> list[Part]:
    """Parts with the days that no later commit has replaced."""
    out, replaced = [], set()
    for commit in reversed(commits(path)):
        for p in commit["parts"]:
            days = [d for d in p["days"] if d not in replaced]
            if days:
                out.append(Part(p["index"], commit["number"], days))
        if commit["replace"]:
            replaced |= {d for p in commit["parts"] for d in p["days"]}
    return out[::-1]


def _rows(path: str, part: Part) -> Iterator[pa.RecordBatch]:
    system, root = _opened(path)
    days, names, texts, held = [], [], [], 0
    wanted = set(part.days)

    def batch() -> pa.RecordBatch:
        columns = [pa.array(days, pa.date32()), pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array([part.commit] * len(days), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["day", "name", "text", "commit"])

    for line in _read(system, f"{root}/{part.index}").splitlines():
        day, name, file = json.loads(line)
        if day not in wanted:
            continue
        text = None if file is None else _read(system, f"{root}/{file}").decode()
        days.append(datetime.date.fromisoformat(day) if day else None)
        names.append(name)
        texts.append(text)
        held += len(text or "")
        if held >= BATCH:
            yield batch()
            days, names, texts, held = [], [], [], 0
    if days:
        yield batch()


class Reader(D.DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.tests: list = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """Takes comparisons of day and commit; Spark keeps the others."""
        compare = {D.EqualTo: lambda a, b: a == b, D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b, D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b, D.In: lambda a, b: a in b}
        for f in filters:
            if type(f) in compare and f.attribute in (("day",), ("commit",)):
                self.tests.append((f.attribute[0], compare[type(f)], f.value))
            elif isinstance(f, D.IsNotNull) and f.attribute == ("day",):
                self.tests.append(("day", lambda a, b: True, None))
            else:
                yield f

    def _fits(self, column: str, value) -> bool:
        return all(value is not None and test(value, other) for name, test, other in self.tests if name == column)

    def partitions(self) -> list[Part]:
        parts = [p for p in visible(self.path) if self._fits("commit", p.commit)]
        kept = [Part(p.index, p.commit, [d for d in p.days if self._fits("day", datetime.date.fromisoformat(d) if d else None)]) for p in parts]
        # a data source must have a partition: one without days reads no file
        return [p for p in kept if p.days] or [Part("", 0, [])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.days:
            yield from _rows(self.path, part)


class StreamReader(D.DataSourceStreamReader):
    """Rows of each commit once, in their order; a day that is replaced comes again with a higher commit."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": max((c["number"] for c in commits(self.path)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        own = [c for c in commits(self.path) if start["commit"] < c["number"] <= end["commit"]]
        return [Part(p["index"], c["number"], p["days"]) for c in own for p in c["parts"]] or [Part("", 0, [])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.days:
            yield from _rows(self.path, part)

    def commit(self, end: dict) -> None:
        """Files stay: retention is expire()'s."""


class Writer(D.DataSourceArrowWriter):
    def __init__(self, path: str, replace: bool):
        self.path, self.replace, self.token = path, replace, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _opened(self.path)
        context = TaskContext.get()
        own = f"{self.token}-{context.partitionId()}-{context.taskAttemptId()}"
        lines, days, files, size = [], set(), 0, 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("day", "name", "text")]
            for day, name, text in zip(*columns):
                folder = day.isoformat() if day else "no-day"
                name = name or ""
                if folder not in days:
                    system.create_dir(f"{root}/{folder}/{own}", recursive=True)
                    days.add(folder)
                file = None
                if text is not None:
                    stem = re.sub(r"[^\w.\-]|^\.+", "_", name) or "_"
                    file = f"{folder}/{own}/{files}-{stem}" if len(stem.encode()) < 200 else f"{folder}/{own}/{files}"
                    data = text.encode()
                    _write(system, f"{root}/{file}", data)
                    size += len(data)
                    files += 1
                lines.append(json.dumps([day.isoformat() if day else "", name, file]))
        if not lines:
            return Written("", [], 0, 0)
        system.create_dir(f"{root}/_index", recursive=True)
        index = f"_index/{own}.jsonl"
        _write(system, f"{root}/{index}", "\n".join(lines).encode())
        return Written(index, sorted(d if d != "no-day" else "" for d in days), files, size)

    def commit(self, messages: list[Written | None]) -> None:
        parts = [{"index": m.index, "days": m.days, "files": m.files, "bytes": m.bytes} for m in messages if m is not None and m.days]
        if not parts:
            return
        system, root = _opened(self.path)
        system.create_dir(f"{root}/_commits", recursive=True)
        number = max((c["number"] for c in commits(self.path)), default=0) + 1
        _write(system, f"{root}/_commits/_{self.token}", json.dumps({"replace": self.replace, "parts": parts}).encode())
        system.move(f"{root}/_commits/_{self.token}", f"{root}/_commits/{number:012d}-{self.token}.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        for m in messages:
            if m is not None and m.days:
                _removed(system, root, m.index)


def _removed(system: fs.FileSystem, root: str, index: str) -> int:
    """Deletes an index's files and itself."""
    folders = set()
    for line in _read(system, f"{root}/{index}").splitlines():
        day, _, file = json.loads(line)
        folders.add(f"{day or 'no-day'}/{index.removeprefix('_index/').removesuffix('.jsonl')}")
    for folder in folders:
        system.delete_dir(f"{root}/{folder}")
    system.delete_file(f"{root}/{index}")
    return len(folders)


class DailyTexts(D.DataSource):
    """Option path: the folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        missing = {"day", "name", "text"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))} to write by day")
        return Writer(self.options["path"], overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with this data source, and with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DailyTexts)
    return spark


def write_texts(rows: DataFrame, path: str, replace: bool = False) -> None:
    """Rows (day, name, text), dealt by ranges of day and name so that each part holds few days and no day is one task's alone."""
    spark = registered(rows.sparkSession)
    # a number is given, as a file costs more to write than its bytes tell: tasks aren't joined for being small
    dealt = rows.select("day", "name", "text").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "day", "name")
    dealt.write.format(FORMAT).option("path", path).mode("overwrite" if replace else "append").save()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return registered(spark).read.format(FORMAT).option("path", path).load()


def stream_texts(spark: SparkSession, path: str) -> DataFrame:
    return registered(spark).readStream.format(FORMAT).option("path", path).load()


def expire(spark: SparkSession, path: str, keep: int) -> int:
    """Deletes parts of which later commits, not counting the last `keep` ones, have replaced every day; how many. Readers of the last `keep` states aren't disturbed."""
    known = commits(path)
    later = known[: len(known) - keep] if keep else known
    replaced, gone = set(), []
    for commit in reversed(later):
        gone += [(commit["file"], p["index"]) for p in commit["parts"] if set(p["days"]) <= replaced]
        if commit["replace"]:
            replaced |= {d for p in commit["parts"] for d in p["days"]}
    system, root = _opened(path)
    for commit in later:  # first out of the commits, so that no reader plans them
        left = [p for p in commit["parts"] if (commit["file"], p["index"]) not in set(gone)]
        if len(left) < len(commit["parts"]):
            _write(system, f"{root}/_commits/_{commit['file']}", json.dumps({"replace": commit["replace"], "parts": left}).encode())
            system.move(f"{root}/_commits/_{commit['file']}", f"{root}/_commits/{commit['file']}")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = _opened(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_removed(own, base, i) for i in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    if gone:
        spark.createDataFrame([(i,) for _, i in gone], "i string").repartition(len(gone)).mapInArrow(drop, "n bigint").agg(F.sum("n")).collect()
    return len(gone)
