"""Folders of evidence files as data sources: fixed schemas, parts of bounded size, pushed filters, and uploads as a stream.

``register(spark)`` makes the formats known; then ``spark.read.format("evidence_sessions").load(path)``. The driver
lists names and sizes only; files are read by tasks, one at a time. A file that can't be read as what it should be
gives one row with its ``file`` and what is wrong as ``fault``, all else null, so that bad files can be counted; in
all other rows ``fault`` is null. Equality and ``in`` on a text column are decided here (``register`` turns on Spark's
setting for that, which the formats need); on the folder's column they spare the reading too.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evidloom.sources import readers

#: Bytes and files of a part, unless the options ``partBytes`` and ``partFiles`` say otherwise.
PART_BYTES, PART_FILES = 64 << 20, 500
#: Rows of a batch.
BATCH = 1000
#: Seconds before a new upload is taken, so that files of one time are seen together (option ``settleSeconds``).
SETTLE = 10.0

#: The extensions of uploads and the types they stand for.
TYPES = {".pdf": "pdf", ".mp4": "video", ".mkv": "video", ".mov": "video"}

Record = dict[str, Any]


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.value = self.files = files


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def _listed(path: str, takes: Callable[[str], bool]) -> list[tuple[str, int, int]]:
    """(path, bytes, time in ns) of the files under a folder, in order; hidden ones and those of other names are left out."""
    system, root = _system(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and takes(f.base_name))


def _parts(files: list[tuple[str, int, int]], most_bytes: int, most_files: int) -> list[Part]:
    out: list[list[tuple[str, int, int]]] = []
    held = 0
    for f in files:
        if not out or held + f[1] > most_bytes or len(out[-1]) >= most_files:
            out.append([])
            held = 0
        out[-1].append(f)
        held += f[1]
    return [Part(p) for p in out]


def _number(options: dict[str, str], name: str, default: float) -> float:
    return float(options.get(name, default))


def _folder(path: str) -> str:
    """The asset that a file's folder is named after, as such or as ``asset=...``."""
    from urllib.parse import unquote

    return re.sub("^asset=", "", unquote(path.split("/")[-2])) if "/" in path else ""


class Files(DataSource):
    """What the formats share. A format says which names it takes and what rows a file gives."""

    #: The column that is named by the folder, if there is one.
    FOLDER: str | None = None
    DDL = ""

    @classmethod
    def name(cls) -> str:
        return "evidence_" + cls.__name__.lower()

    def schema(self) -> str:
        return self.DDL

    def reader(self, schema: StructType) -> DataSourceReader:
        return FilesReader(type(self), dict(self.options), schema)

    @staticmethod
    def takes(name: str) -> bool:
        return name.endswith(".json")

    @staticmethod
    def rows(path: str, size: int, mtime: int, read: Callable[[], bytes]) -> Iterator[Record]:
        raise NotImplementedError


def _batches(source: type[Files], schema: StructType, system_of: str, files: list[tuple[str, int, int]], keep: Callable[[Record], bool]) -> Iterator[pa.RecordBatch]:
    """The rows of files in batches; a file's rows come whole or, if one of them doesn't fit the schema, as a fault."""
    system, _ = _system(system_of)
    arrow = to_arrow_schema(schema)
    kind = pa.struct(list(arrow))
    with_faults = "fault" in schema.fieldNames()
    held: list[pa.Array] = []
    for path, size, mtime in files:
        try:
            def read(path: str = path) -> bytes:
                with system.open_input_stream(path) as f:
                    return f.read()

            rows = [r | {"file": path} if with_faults else r for r in source.rows(path, size, mtime, read)]
            array = pa.array([r for r in rows if keep(r)], kind)
        except (ValueError, TypeError, KeyError, AttributeError, pa.ArrowException) as e:
            if not with_faults:
                raise
            array = pa.array([{"file": path, "fault": type(e).__name__}], kind)
        held.append(array)
        if sum(map(len, held)) >= BATCH:
            yield pa.RecordBatch.from_struct_array(pa.concat_arrays(held)).cast(arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_struct_array(pa.concat_arrays(held)).cast(arrow)


class FilesReader(DataSourceReader):
    def __init__(self, source: type[Files], options: dict[str, str], schema: StructType):
        self.source, self.schema = source, schema
        self.path = options["path"]
        self.part_bytes = int(_number(options, "partbytes", _number(options, "partBytes", PART_BYTES)))
        self.part_files = int(_number(options, "partfiles", _number(options, "partFiles", PART_FILES)))
        self.texts = {f.name for f in schema.fields if f.dataType.typeName() == "string"} - {"fault"}
        self.wanted: list[tuple[str, frozenset[str]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and ``in`` on text columns; the others are Spark's."""
        for f in filters:
            name, values = (f.attribute, (f.value,)) if isinstance(f, EqualTo) else (f.attribute, f.value) if isinstance(f, In) else ((), ())
            if len(name) == 1 and name[0] in self.texts and all(isinstance(v, str) for v in values):
                self.wanted.append((name[0], frozenset(values)))
                if "fault" in self.schema.fieldNames():
                    yield f  # Spark looks too, as bad files come past
            else:
                yield f

    def partitions(self) -> list[Part]:
        files = _listed(self.path, self.source.takes)
        for name, values in self.wanted:
            if name == self.source.FOLDER:
                files = [f for f in files if _folder(f[0]) in values]
        return _parts(files, self.part_bytes, self.part_files)

    def _keep(self, row: Record) -> bool:
        return all(row.get(name) in values for name, values in self.wanted)

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:  # none: there are no parts
        return _batches(self.source, self.schema, self.path, part.files if part else [], self._keep)


class Registry(Files):
    """One row for each asset of the registry files, bare or under ``assets_map``; missing fields get their defaults."""

    DDL = f"{readers.ASSET}, file string, fault string"

    @staticmethod
    def rows(path, size, mtime, read):
        found = json.loads(read())
        for key, asset in (found.get("assets_map") or found).items():
            own = {k: v for k, v in asset.items() if v is not None}
            yield {"asset_id": key, "status": "Raw", "retry_count": 0} | own


class Sessions(Files):
    """One row for each session of the files, each a session or one in each line; a file with one without an id is a fault."""

    DDL = f"{readers.SESSION}, file string, fault string"

    @staticmethod
    def rows(path, size, mtime, read):
        data = read()
        try:
            records = [json.loads(data)]
        except json.JSONDecodeError:
            records = [json.loads(line) for line in data.split(b"\n") if line.strip()]
            if not records:
                raise
        for found in records:
            if found["chat_id"] is None:
                raise KeyError("chat_id")
            yield found


class Transcripts(Files):
    """One row for each segment of the transcript files, each a transcript or one in each line."""

    DDL = "asset string, start double, end double, segment_id int, text string, file string, fault string"

    @staticmethod
    def rows(path, size, mtime, read):
        text = read().decode()
        try:
            records = [json.loads(text)]
        except json.JSONDecodeError:
            records = [json.loads(line) for line in text.splitlines() if line.strip()]
        for found in records:
            for i, s in enumerate(found["segments"]):
                yield {"asset": found["asset_id"], "start": s["start"], "end": s["end"], "segment_id": i, "text": s["text"]}


class Frames(Files):
    """One row for each frame file, of the asset that its folder names; names without a time are left out, nothing is read."""

    FOLDER = "asset"
    DDL = "asset string, ts double, frame_id string, path string, length bigint"

    @staticmethod
    def takes(name):
        return re.fullmatch(r"time_[0-9]+(\.[0-9]+)?\.jpg", name) is not None

    @staticmethod
    def rows(path, size, mtime, read):
        name = path.split("/")[-1]
        yield {"asset": _folder(path), "ts": float(name[len("time_") : -len(".jpg")]), "frame_id": name, "path": path, "length": size}


class Uploads(Files):
    """One row for each upload of a known type; also as a stream, whose offset is the time of the newest file taken.

    A file counts once it is ``settleSeconds`` old. The files of a batch are those changed after the one offset and
    no later than the other, so that a batch that runs again has the same files; one put there with an older time
    than the offset is not seen.
    """

    DDL = "asset_id string, asset_type string, path string, length bigint, changed_ns bigint"

    @staticmethod
    def takes(name):
        return name[name.rfind(".") :].lower() in TYPES

    @staticmethod
    def rows(path, size, mtime, read):
        name = path.split("/")[-1]
        yield {"asset_id": name, "asset_type": TYPES[name[name.rfind(".") :].lower()], "path": path, "length": size, "changed_ns": mtime}

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return UploadStream(dict(self.options), schema)


class UploadStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema = options["path"], schema
        self.settle = int(1e9 * _number(options, "settleseconds", _number(options, "settleSeconds", SETTLE)))
        self.newest = 0

    def initialOffset(self) -> dict[str, int]:
        return {"until": 0}

    def latestOffset(self) -> dict[str, int]:
        now = time.time_ns() - self.settle
        self.newest = max([self.newest, *(t for _, _, t in _listed(self.path, Uploads.takes) if t <= now)])
        return {"until": self.newest}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Part]:
        return _parts([f for f in _listed(self.path, Uploads.takes) if start["until"] < f[2] <= end["until"]], PART_BYTES, PART_FILES)

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        return _batches(Uploads, self.schema, self.path, part.files if part else [], lambda row: True)


FORMATS = (Registry, Sessions, Transcripts, Frames, Uploads)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for f in FORMATS:
        spark.dataSource.register(f)
