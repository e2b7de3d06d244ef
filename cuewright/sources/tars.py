"""Tar shards as a Spark data source: format ``tar_shards`` reads and writes them member by member.

A sample is a run of members with one stem. Writing streams each task's rows into shards that are closed
once they have reached a size or a number of samples; nothing is visible until the job commits, which
moves the finished shards into place and writes a marker with their names. Each task also leaves a manifest part with one line a
sample. Reading deals runs of shards to tasks, passes over each file once and yields members as they come, so neither a
shard nor a sample has to fit in a row. Files are opened by ``pyarrow.fs``: local paths and the stores it knows.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
import tarfile
import uuid
from dataclasses import dataclass, field
from itertools import product

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

MEMBERS = "shard string, shard_index int, sample_index int, sample_key string, member string, data binary"
#: A shard is closed once it has reached so many bytes or samples.
MAX_BYTES, MAX_SAMPLES = 1_000_000_000, 100_000
#: Rows and bytes of an Arrow batch that a reader yields; a larger member stands alone.
BATCH_ROWS, BATCH_BYTES = 1_000, 32 << 20
#: A reading task takes shards up to so many bytes, each with what it costs to open it; but there are about so many tasks at least.
TASK_BYTES, OPEN_BYTES, LEAST_TASKS = 128 << 20, 256 << 10, 32


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path if "//" in path else path.replace(":", "://", 1))
    return fs.LocalFileSystem(), path


def braces(pattern: str) -> list[str]:
    """Shell braces spelled out: ``{a,b}``, ``{000..012}``, one in another too. Braces with neither stay."""
    depth, start = 0, -1
    for i, c in enumerate(pattern):
        if c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                body, rest = pattern[start + 1 : i], braces(pattern[i + 1 :])
                inside = _choices(body)
                return [pattern[:start] + a + b for a, b in product(inside, rest)]
    return [pattern]


def _choices(body: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            parts.append(body[last:i])
            last = i + 1
    parts.append(body[last:])
    if len(parts) > 1:
        return [x for p in parts for x in braces(p)]
    m = re.fullmatch(r"(\d+)\.\.(\d+)", body)
    if m:
        a, b, width = int(m[1]), int(m[2]), len(m[1]) if m[1].startswith("0") else 0
        return [str(n).zfill(width) for n in range(a, b + (1 if b >= a else -1), 1 if b >= a else -1)]
    return ["{" + x + "}" for x in braces(body)]


def expand(patterns: str) -> list[str]:
    """Sorted, distinct files of comma-free patterns with braces and wildcards (``*`` stays within a folder)."""
    return sorted(sizes(patterns))


def sizes(patterns: str) -> dict[str, int]:
    """The files that ``expand`` names with their sizes."""
    found = {}
    for pattern in braces(patterns):
        wild = re.search(r"[*?\[]", pattern)
        head = pattern[: wild.start()].rsplit("/", 1)[0] if wild else pattern
        at, base = store(head or "/")
        if not wild:
            f = at.get_file_info(base)
            if f.type == fs.FileType.File:
                found[pattern] = f.size
            continue
        steps = pattern[len(head) :].strip("/").split("/")
        # folders below are looked into only where the pattern has more than one step
        for f in at.get_file_info(fs.FileSelector(base, recursive=len(steps) > 1, allow_not_found=True)):
            mine = f.path[len(base.rstrip("/")) :].strip("/").split("/")
            if f.type == fs.FileType.File and len(mine) == len(steps) and all(map(fnmatch.fnmatchcase, mine, steps)):
                found["/".join([head, *mine])] = f.size
    return found


def split_name(name: str) -> tuple[str, str]:
    """(sample key, member): the folder and all before the name's first dot, and what follows it."""
    folder, _, base = name.rpartition("/")
    stem, _, ext = base.partition(".")
    return (f"{folder}/{stem}" if folder else stem), ext


# ---- reading


@dataclass
class Shards(InputPartition):
    """Shards that one task reads in order, with their indexes."""

    shards: list[tuple[str, int]]


class TarReader(DataSourceReader):
    """Members of the shards in ``path``; members not asked for are skipped, not read. Small shards that follow each other share a task."""

    def __init__(self, options: dict):
        self.sizes = sizes(options["path"])
        names = options.get("members", "")
        self.members = set(names.split(",")) if names else None
        if not self.sizes:
            raise FileNotFoundError(f"no shard matches {options['path']}")

    def partitions(self):
        cost = [(p, size + OPEN_BYTES) for p, size in sorted(self.sizes.items())]
        most = min(TASK_BYTES, sum(c for _, c in cost) / LEAST_TASKS)
        out, room = [], 0.0
        for i, (path, c) in enumerate(cost):
            if not out or c > room:
                out.append(Shards([]))
                room = most
            out[-1].shards.append((path, i))
            room -= c
        return out

    def read(self, partition: Shards):
        rows, size = [], 0
        for name, index in partition.shards:
            at, path = store(name)
            key, sample = None, -1
            with at.open_input_file(path) as raw, tarfile.open(fileobj=raw, mode="r:") as tar:
                while (m := tar.next()) is not None:
                    tar.members = []  # else the archive remembers each of its members
                    if not m.isfile():
                        continue
                    stem, member = split_name(m.name)
                    if stem != key:
                        key, sample = stem, sample + 1
                    if self.members is None or member in self.members:
                        rows.append((name, index, sample, stem, member, tar.extractfile(m).read()))
                        size += m.size
                        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
        if rows:
            yield _batch(rows)


class PushingTarReader(TarReader):
    """Answers filters on ``member`` itself. Spark takes such a reader only where its filter pushdown is enabled."""

    def pushFilters(self, filters):
        for f in filters:
            mine = isinstance(f, (EqualTo, In)) and f.attribute == ("member",)
            if mine:
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.members = names if self.members is None else self.members & names
            else:
                yield f


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["shard", "shard_index", "sample_index", "sample_key", "member", "data"])


# ---- writing


@dataclass
class Written(WriterCommitMessage):
    """What a task leaves in the job's temporary folder: (file name, samples, bytes) of its shards, and its manifest part."""

    shards: list[tuple[str, int, int]] = field(default_factory=list)
    manifest: str = ""
    folder: str = ""


class _Task:
    """The open shard and manifest part of one task."""

    def __init__(self, at: fs.FileSystem, folder: str, name: str, max_bytes: int, max_samples: int):
        self.at, self.folder, self.name, self.max_bytes, self.max_samples = at, folder, name, max_bytes, max_samples
        self.done, self.tar, self.raw, self.key, self.group = Written(), None, None, None, None
        self.lines = None

    def close_shard(self) -> None:
        if self.tar is not None:
            self.tar.close()
            self.raw.close()
            self.done.shards.append((self.file, self.samples, self.bytes))
            self.tar = None

    def open_shard(self) -> None:
        self.file = f"{self.name}-{len(self.done.shards):06d}.tar" if self.group is None else f"{int(self.group):06d}.tar"
        self.raw = self.at.open_output_stream(f"{self.folder}/{self.file}")
        self.tar, self.samples, self.bytes = tarfile.open(fileobj=self.raw, mode="w|"), 0, 0

    def end_sample(self) -> None:
        if self.key is None:
            return
        line = self.more | {"sample_key": self.key, "shard": self.file, "sample_index": self.samples, "members": self.n, "bytes": self.size, "content_sha256": self.digest.hexdigest()}
        if self.lines is None:
            self.done.manifest = f"manifest-{self.name}.jsonl"
            self.lines = self.at.open_output_stream(f"{self.folder}/{self.done.manifest}")
        self.lines.write((json.dumps(line, sort_keys=True) + "\n").encode())
        self.samples += 1
        self.key = None

    def add(self, key: str, member: str, data: bytes, group, more: dict) -> None:
        if not key or not member:
            raise ValueError(f"a member needs a sample key and a name, got {key!r} and {member!r}")
        if key != self.key or group != self.group:
            self.end_sample()
            if self.tar is not None and (group != self.group or group is None and (self.bytes >= self.max_bytes or self.samples >= self.max_samples)):
                self.close_shard()
            self.group = group
            if self.tar is None:
                self.open_shard()
            self.key, self.digest, self.n, self.size, self.more = key, hashlib.sha256(), 0, 0, more
        info = tarfile.TarInfo(f"{key}.{member}")
        info.size = len(data)
        self.tar.addfile(info, pa.BufferReader(data))
        self.digest.update(member.encode() + data)
        self.n, self.size, self.bytes = self.n + 1, self.size + len(data), self.bytes + len(data)


class TarWriter(DataSourceArrowWriter):
    """Rows (sample_key, member, data, further columns of the manifest), each sample's rows together and in order of their member.

    With a column ``shard`` rows of one number, also together, make one shard, whatever its size.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.at_path, self.overwrite = options["path"], overwrite
        at, self.path = store(self.at_path)
        self.max_bytes, self.max_samples = int(options.get("max_bytes", MAX_BYTES)), int(options.get("max_samples", MAX_SAMPLES))
        self.temporary = f"{self.path}/_temporary/{uuid.uuid4().hex}"
        have = [] if overwrite else [f.base_name for f in at.get_file_info(fs.FileSelector(self.path, allow_not_found=True))]
        self.generation = sum(name.startswith("committed-") for name in have)

    def write(self, iterator) -> Written:
        at, _ = store(self.at_path)
        task = TaskContext.get()
        folder = f"{self.temporary}/{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}"
        at.create_dir(folder)
        out = _Task(at, folder, f"{self.generation:04d}-{task.partitionId():06d}", self.max_bytes, self.max_samples)
        for batch in iterator:
            names = batch.schema.names
            more = [c for c in names if c not in ("shard", "sample_key", "member", "data")]
            group = batch.column("shard") if "shard" in names else None
            for i, (key, member, data) in enumerate(zip(batch.column("sample_key"), batch.column("member"), batch.column("data"))):
                out.add(key.as_py(), member.as_py(), data.as_py() or b"", None if group is None else group[i].as_py(), {c: batch.column(c)[i].as_py() for c in more})
        out.end_sample()
        out.close_shard()
        if out.lines is not None:
            out.lines.close()
        out.done.folder = folder
        return out.done

    def commit(self, messages) -> None:
        at, _ = store(self.at_path)
        if self.overwrite:
            for f in at.get_file_info(fs.FileSelector(self.path, allow_not_found=True)):
                if f.type == fs.FileType.File:
                    at.delete_file(f.path)
        shards = []
        for m in messages:
            for name, samples, size in m.shards:
                at.move(f"{m.folder}/{name}", f"{self.path}/{name}")
                shards.append({"shard": name, "samples": samples, "bytes": size})
            if m.manifest:
                at.move(f"{m.folder}/{m.manifest}", f"{self.path}/{m.manifest}")
        with at.open_output_stream(f"{self.path}/committed-{self.generation:04d}.json") as out:
            out.write(json.dumps(sorted(shards, key=lambda s: s["shard"])).encode())
        self._clear(at)

    def abort(self, messages) -> None:
        at, _ = store(self.at_path)
        self._clear(at)

    def _clear(self, at: fs.FileSystem) -> None:
        if at.get_file_info(self.temporary).type == fs.FileType.Directory:
            at.delete_dir(self.temporary)
        above = f"{self.path}/_temporary"
        if at.get_file_info(above).type == fs.FileType.Directory and not at.get_file_info(fs.FileSelector(above)):
            at.delete_dir(above)


class TarShards(DataSource):
    """``spark.read.format("tar_shards").load(pattern)`` and ``df.write.format("tar_shards").save(folder)``.

    Options: ``members`` (names to read, by comma), ``pushdown`` (true: filters name them too), ``max_bytes`` and ``max_samples`` of a written shard.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> TarReader:
        return (PushingTarReader if self.options.get("pushdown") == "true" else TarReader)(self.options)

    def writer(self, schema, overwrite: bool) -> TarWriter:
        return TarWriter(self.options, overwrite)
