"""The writing side of ``format("tarshards")``: archives become visible all together, or not at all."""

from __future__ import annotations

import io
import json
import re
import tarfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructType

from .sinks import filesystem_of

STAGING, JOURNAL = "_staging-", "_commit-"
#: Name of a part of a shard: the ordinal of its first member stands before the ending.
_PART = re.compile(r"@(\d{9,})\.tar$")


def part_name(shard: str, first: int) -> str:
    return f"{shard.removesuffix('.tar')}@{first:09d}.tar"


def first_ordinal(name: str) -> int:
    """Ordinal of the first member of an archive that was written in parts."""
    found = _PART.search(name)
    return int(found[1]) if found else 0


def whole_name(name: str) -> str:
    """The shard that a part belongs to."""
    return _PART.sub(".tar", name)


@dataclass
class Archive:
    """An archive that a task has closed: its name in the folder, where it is staged, what it holds."""

    shard: str
    staged: str
    nsamples: int
    size_bytes: int
    members: int = 0
    first_key: str = ""
    last_key: str = ""


@dataclass
class TarCommit(WriterCommitMessage):
    archives: list[Archive]


class TarShardWriter(DataSourceArrowWriter):
    """Rows ``shard, key`` and a binary column per member extension, in the order in which they are to stand.

    A task streams its rows into archives below a staging folder of its own attempt.  The driver gets the names of
    the archives of the attempts that count, writes them to a journal and moves them into place; a job that
    fails before that leaves nothing, and one that dies while moving is finished by the next writer
    (:func:`finish_commits`).  Readers leave the shards of an unfinished journal out.

    All rows of a shard must come together in one task, or, with ``parts``, in ranges of ascending keys that do not
    overlap: then a shard is as many archives as tasks had rows of it, named by the ordinal of their first member
    (:func:`part_name`), and no task holds more than its range.  Options: ``may_lack`` (extensions that a sample may do
    without, any other null payload stops the job), ``replace`` (a shard of the same name gives way instead of
    stopping the job), ``report`` (folder for a JSON-lines list of ``shard, nsamples, size_bytes``).  Mode
    overwrite also removes the shards that the job has not written.
    """

    def __init__(self, schema: StructType, options, overwrite: bool):
        self.folder = options["path"].rstrip("/")
        self.overwrite = overwrite
        self.replace = options.get("replace", "false").lower() == "true"
        self.report = options.get("report")
        self.parts = options.get("parts", "false").lower() == "true"
        self.may_lack = {e for e in options.get("may_lack", "").split(",") if e}
        self.extensions = [f.name for f in schema.fields if f.name not in ("shard", "key")]
        wrong = [f.name for f in schema.fields if f.name in self.extensions and f.dataType != BinaryType()]
        if wrong or not {"shard", "key"} <= set(schema.fieldNames()):
            raise ValueError(f"Shards need the columns shard and key and binary members; not binary: {wrong}")
        self.job = uuid.uuid4().hex
        finish_commits(self.folder)
        # Tasks write below it but never make it: one that starts after the job was aborted fails and leaves nothing.
        filesystem, root = filesystem_of(self.folder)
        filesystem.create_dir(f"{root}/{STAGING}{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TarCommit:
        filesystem, root = filesystem_of(self.folder)
        place = f"{root}/{STAGING}{self.job}/{uuid.uuid4().hex}"
        filesystem.create_dir(place, recursive=False)
        done: dict[str, Archive] = {}
        sink = archive = current = key = None
        count = 0

        def close():
            archive.close()
            done[current].size_bytes, done[current].nsamples = sink.tell(), count
            sink.close()

        try:
            for batch in iterator:
                shards, keys = batch.column("shard"), batch.column("key")
                payloads = [batch.column(e) for e in self.extensions]
                for row in range(batch.num_rows):
                    shard = shards[row].as_py()
                    if shard != current:
                        if current is not None:
                            close()
                        if not shard or shard in done:
                            raise ValueError(f"Rows of shard {shard!r} are nameless or do not come together")
                        current, count, key = shard, 0, None
                        done[shard] = Archive(shard, f"{place}/{len(done)}.tar", 0, 0)
                        sink = filesystem.open_output_stream(done[shard].staged)
                        archive = tarfile.open(fileobj=sink, mode="w|", format=tarfile.PAX_FORMAT)
                    before, key = key, keys[row].as_py()
                    if self.parts:
                        if key is None or (before is not None and key < before):
                            raise ValueError(f"Keys of shard {shard!r} do not ascend at {key!r}")
                        if before is None:
                            done[shard].first_key = key
                        done[shard].last_key = key
                    for ext, payload in zip(self.extensions, payloads):
                        name = f"{key}.{ext}"
                        if not payload[row].is_valid:
                            if ext in self.may_lack:
                                continue
                            raise ValueError(f"{name} has no payload")
                        content = payload[row].as_buffer()
                        info = tarfile.TarInfo(name)
                        info.size, info.mtime, info.mode = content.size, 0, 0o644
                        archive.addfile(info, io.BytesIO(content))
                        done[shard].members += 1
                    count += 1
            if current is not None:
                close()
        except BaseException:
            if sink is not None and not sink.closed:
                sink.close()
            filesystem.delete_dir(place)
            raise
        return TarCommit(list(done.values()))

    def commit(self, messages: list[TarCommit | None]) -> None:
        filesystem, root = filesystem_of(self.folder)
        archives = sorted((a for m in messages if m is not None for a in m.archives), key=lambda a: (a.shard, a.first_key))
        wholes = {a.shard for a in archives}
        if self.parts:
            _name_parts(archives)
        names = [a.shard for a in archives]
        twice = {a for a, b in zip(names, names[1:]) if a == b}
        if twice:
            raise ValueError(f"Rows of shard {min(twice)} came to several tasks")
        there = _shards(filesystem, root)
        known = {n for n in there if (whole_name(n) if self.parts else n) in wholes}
        if not (self.overwrite or self.replace) and known:
            raise FileExistsError(f"Shard {min(known)} exists")
        given_up = there if self.overwrite else known
        journal = {
            "moves": [[a.staged, f"{root}/{a.shard}"] for a in archives],
            "deletes": [f"{root}/{name}" for name in sorted(given_up - set(names))],
            "staging": f"{root}/{STAGING}{self.job}",
        }
        filesystem.create_dir(root, recursive=True)
        if self.report:
            lines = "".join(json.dumps({"shard": a.shard, "nsamples": a.nsamples, "size_bytes": a.size_bytes}) + "\n" for a in archives)
            _write(*filesystem_of(f"{self.report}/{self.job}.json"), lines)
        _write(filesystem, f"{root}/{JOURNAL}{self.job}.json", json.dumps(journal))
        finish_commits(self.folder, self.job)

    def abort(self, messages: list[TarCommit | None]) -> None:
        from pyarrow import fs

        filesystem, root = filesystem_of(self.folder)
        if filesystem.get_file_info(f"{root}/{JOURNAL}{self.job}.json").type != fs.FileType.NotFound:
            return  # decided already; the next writer finishes it
        place = f"{root}/{STAGING}{self.job}"
        if filesystem.get_file_info(place).type != fs.FileType.NotFound:
            filesystem.delete_dir(place)


def _name_parts(archives: list[Archive]) -> None:
    """Names the archives of each shard, which are in order, by the ordinal of their first member."""
    whole, last, first = None, None, 0
    for a in archives:
        if a.shard != whole:
            whole, first = a.shard, 0
        elif a.first_key <= last:
            raise ValueError(f"Key {a.first_key!r} of shard {whole} came to several tasks")
        last, a.shard, first = a.last_key, part_name(whole, first), first + a.members


def _write(filesystem, path: str, text: str) -> None:
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with filesystem.open_output_stream(f"{path}.tmp") as out:
        out.write(text.encode())
    filesystem.move(f"{path}.tmp", path)


def _below(filesystem, root: str, recursive: bool = False) -> list:
    from pyarrow import fs

    return filesystem.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=recursive))


def _shards(filesystem, root: str) -> set[str]:
    """Names of the archives below a folder, staged ones left out."""
    from pyarrow import fs

    out, todo = set(), [root]
    while todo:
        for f in _below(filesystem, todo.pop()):
            if f.type == fs.FileType.Directory and not f.base_name.startswith("_"):
                todo.append(f.path)
            elif f.path.endswith(".tar"):
                out.add(f.path.removeprefix(f"{root}/"))
    return out


def _journals(filesystem, root: str) -> list[str]:
    return [f.path for f in _below(filesystem, root) if f.base_name.startswith(JOURNAL) and f.base_name.endswith(".json")]


def visible_shards(uri: str) -> list[str]:
    """URIs of the archives of a folder, without those of a commit that is not finished yet; of a file, its own."""
    from pyarrow import fs

    filesystem, path = filesystem_of(uri)
    root, whole = path.rstrip("/"), uri.rstrip("/")
    scheme = whole.removesuffix(root) if "://" in whole else ""
    if filesystem.get_file_info(root).type != fs.FileType.Directory:
        return [scheme + root]
    pending: set[str] = set()
    for journal in _journals(filesystem, root):
        entry = _read(filesystem, journal)
        if entry:
            pending |= {to for _, to in entry["moves"]} | set(entry["deletes"])
    return [scheme + p for p in sorted({f"{root}/{s}" for s in _shards(filesystem, root)} - pending)]


def _read(filesystem, journal: str) -> dict | None:
    try:
        with filesystem.open_input_stream(journal) as stream:
            return json.loads(stream.read())
    except FileNotFoundError:  # finished meanwhile
        return None


def finish_commits(folder: str, job: str | None = None) -> None:
    """Finish the commits whose journal stands in ``folder`` (of one job, or all); doing it twice does no harm."""
    from pyarrow import fs

    filesystem, root = filesystem_of(folder)
    for journal in _journals(filesystem, root):
        if job and not journal.endswith(f"{job}.json"):
            continue
        entry = _read(filesystem, journal)
        if entry is None:
            continue

        def move(pair: list[str], filesystem=filesystem) -> None:
            staged, target = pair
            if filesystem.get_file_info(staged).type == fs.FileType.NotFound:
                if filesystem.get_file_info(target).type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{staged} of an unfinished commit is gone")
                return  # moved by the run that broke off
            filesystem.create_dir(target.rsplit("/", 1)[0], recursive=True)
            try:
                filesystem.move(staged, target)
            except FileNotFoundError:  # another process finishes the same commit
                if filesystem.get_file_info(target).type == fs.FileType.NotFound:
                    raise

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, entry["moves"]))
        for path in entry["deletes"]:
            if filesystem.get_file_info(path).type != fs.FileType.NotFound:
                filesystem.delete_file(path)
        if filesystem.get_file_info(entry["staging"]).type != fs.FileType.NotFound:
            filesystem.delete_dir(entry["staging"])
        filesystem.delete_file(journal)
