"""A data source for settings files: ``spark.read.format("settings")`` and, for files that arrive, ``spark.readStream``.

Rows are ``(file, line_no, key, value)`` as ``read_properties_files`` gives them. Register it once for each session
with ``register_settings``. Options: ``path`` (or ``load(path)``), a folder or file, searched recursively, on any file system
pyarrow can open; ``bytesPerTask``, how much of many small files a task reads (a larger file is one task);
``settleSeconds``, for streams: files changed more recently are left for the next batch, so one that is still being written,
or arrives with the same time as the newest, is not missed.

Options that select: ``keys``, a JSON list of the keys wanted, applied to each line before it leaves the reader, and
``files``, a pattern for the path below the folder (as in a shell), which decides which files are opened. They are options,
not filters Spark pushes down by itself: in Spark 4.1.2 a filter pushed into a Python source stays with the loaded frame,
so that another query on the same frame misses rows (``w.where("key = 'A'").count()``, then ``w.count()``). Filters are
therefore left to Spark, over the rows the options let through.
"""

from __future__ import annotations

import json
import sys
import time
from fnmatch import fnmatchcase

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no basin installation

SCHEMA = "file STRING, line_no BIGINT, key STRING, value STRING"
BYTES_PER_TASK = 32 << 20


def _open(path: str):
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:"):])
    return fs.LocalFileSystem(), path


def _files(path: str):
    """(path, size, change time in nanoseconds) of every file under ``path``; hidden ones and marks of jobs are left out."""
    from pyarrow import fs
    system, root = _open(path)
    found = system.get_file_info(root)
    infos = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    parts = lambda p: p[len(root):].split("/") if p != root else [p.rsplit("/", 1)[-1]]
    kept = [f for f in infos if f.type == fs.FileType.File and not any(x[:1] in ("_", ".") for x in parts(f.path))]
    return sorted((f.path, f.size or 0, f.mtime_ns or 0) for f in kept)


def parse(text: str):
    """(line number from 1, key, value) of the lines that set something."""
    for number, line in enumerate(text.split("\n"), 1):
        at = line.find("=")
        if at < 0 or line.lstrip(" \t")[:1] in ("", "#"):
            continue
        value = line[at + 1:].strip(" ")
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        yield number, line[:at].strip(" "), value


class _Files(InputPartition):
    def __init__(self, files):
        super().__init__(None)
        self.files = files


class _Reading:
    """What batch and stream readers share: dealing files over tasks, and reading a task's files."""

    def __init__(self, options: dict):
        self.options, self.path = options, options["path"]
        self.keys = set(json.loads(options["keys"])) if "keys" in options else None

    def files(self):
        root = _open(self.path)[1].rstrip("/")
        below = lambda p: p[len(root) + 1:] or p.rsplit("/", 1)[-1]
        return [f for f in _files(self.path) if fnmatchcase(below(f[0]), self.options.get("files", "*"))]

    def dealt(self, files):
        out, size = [[]], 0
        for path, bytes_, _ in files:
            if out[-1] and size + bytes_ > int(self.options.get("bytespertask", BYTES_PER_TASK)):
                out.append([])
                size = 0
            out[-1].append(path)
            size += bytes_
        return [_Files(f) for f in out if f]

    def read(self, partition):
        if partition is None:  # no file at all
            return
        system, _ = _open(self.path)
        uri = "file://" if system.type_name == "local" else ""
        for path in partition.files:
            with system.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
            for number, key, value in parse(text):
                if self.keys is None or key in self.keys:
                    yield uri + path, number, key, value


class SettingsReader(_Reading, DataSourceReader):
    def partitions(self):
        return self.dealt(self.files())


class SettingsStreamReader(_Reading, DataSourceStreamReader):
    """Offsets are change times: a batch has the files changed after its start and up to its end."""

    def initialOffset(self):
        return {"changed": 0}

    def latestOffset(self):
        settled = time.time_ns() - int(float(self.options.get("settleseconds", 5)) * 1e9)
        times = [t for _, _, t in self.files() if t <= settled]
        self.latest = max([getattr(self, "latest", 0), *times])
        return {"changed": self.latest}

    def partitions(self, start, end):
        return self.dealt([f for f in self.files() if start["changed"] < f[2] <= end["changed"]])


class SettingsSource(DataSource):
    @classmethod
    def name(cls):
        return "settings"

    def schema(self):
        return SCHEMA

    def _options(self):
        options = {k.lower(): v for k, v in self.options.items()}
        if not options.get("path"):
            raise ValueError("the settings source needs a path")
        return options

    def reader(self, schema):
        return SettingsReader(self._options())

    def streamReader(self, schema):
        return SettingsStreamReader(self._options())


def register_settings(spark: SparkSession) -> None:
    """Make the format ``settings`` known to a session."""
    spark.dataSource.register(SettingsSource)
