"""Embedding files as a Spark data source: NumPy arrays or pickles, read and written by the tasks.

``format("embedding_files")`` with option ``kind``:

* ``npy``: a pair of files, ``NAME.npy`` with an array of vectors (float32, a row each)
  and ``NAME.ids.npy`` with their keys; an array without a file of keys gets its rows'
  numbers, in order of the files' names. ``numpy.load`` opens all of them.
* ``pkl``: ``NAME.pkl``, a dictionary of ``ids`` and ``embeddings``. Only plain values and
  NumPy arrays are unpickled; anything else raises.

A folder is read a file per partition. Writers cut at ``rows`` vectors a file. Tasks write
under a folder of the job; the commit moves what successful tasks report into place and
then puts ``metadata.json`` there, an abort removes the job's folder. So neither lost
executors nor repeated attempts leave rows twice. Paths may have any scheme that Arrow's
file systems know, and must be shared by all executors.

Null vectors raise; vectors of different lengths raise. Keys are integers or texts.
"""

from __future__ import annotations

import io
import json
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructType

#: Vectors in a file, at most.
ROWS = 65_536
_KEYS, _JOB = ".ids.npy", "_writing-"


class _Plain(pickle.Unpickler):
    """Unpickles plain values and arrays only."""

    def find_class(self, module: str, name: str):
        if module.split(".")[0] == "numpy" and name in ("_reconstruct", "ndarray", "dtype", "scalar", "_frombuffer"):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} isn't allowed in a file of embeddings")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _bytes(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_stream(path) as f:
        return f.read()


def _array(raw: bytes) -> np.ndarray:
    return np.load(io.BytesIO(raw), allow_pickle=False)


def _saved(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def _names(system: fs.FileSystem, path: str, kind: str) -> list[str]:
    found = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.is_file]
    return sorted(p for p in found if p.endswith(f".{kind}") and not p.endswith(_KEYS))


def read_file(system: fs.FileSystem, path: str, kind: str, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a file."""
    if kind == "pkl":
        held = _Plain(io.BytesIO(_bytes(system, path))).load()
        return np.asarray(held["ids"]), np.asarray(held["embeddings"], np.float32)
    vectors = _array(_bytes(system, path)).astype(np.float32, copy=False)
    keys = path.removesuffix(".npy") + _KEYS
    if system.get_file_info(keys).is_file:
        return _array(_bytes(system, keys)), vectors
    return np.arange(first, first + len(vectors)), vectors


@dataclass
class _File(InputPartition):
    path: str
    first: int


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]
    rows: int
    dimensions: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.kind, self.schema = options["path"], options.get("kind", "npy"), schema

    def partitions(self) -> list[_File]:
        system, path = _place(self.path)
        out, first = [], 0
        for name in _names(system, path, self.kind):
            out.append(_File(name, first))
            if self.kind == "npy" and not system.get_file_info(name.removesuffix(".npy") + _KEYS).is_file:
                with system.open_input_file(name) as f:  # the header has the number of rows
                    version = np.lib.format.read_magic(f)
                    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                    first += read(f)[0][0]
        return out

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        keys, vectors = read_file(system, partition.path, self.kind, partition.first)
        if len(keys) != len(vectors):
            raise ValueError(f"{partition.path} has {len(keys)} keys and {len(vectors)} vectors")
        text = isinstance(self.schema.fields[0].dataType, StringType)
        for at in range(0, len(keys), 10_000):
            own, part = keys[at : at + 10_000], vectors[at : at + 10_000]
            column = pa.array(own.astype(str).tolist(), pa.string()) if text else pa.array(own.astype(np.int64))
            offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
            yield pa.RecordBatch.from_arrays([column, pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], self.schema.names)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options.get("kind", "npy"), overwrite
        self.rows, self.job = int(options.get("rows", ROWS)), _JOB + uuid.uuid4().hex
        if self.kind not in ("npy", "pkl"):
            raise ValueError("kind must be npy or pkl")
        if len(schema.fields) != 2 or not isinstance(schema.fields[0].dataType, (LongType, StringType)):
            raise ValueError("files of embeddings have a key (bigint or string) and a vector")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        system, path = _place(self.path)
        system.create_dir(f"{path}/{self.job}")
        names, total, width, keys, vectors = [], 0, 0, [], []

        def put() -> None:
            name = f"part-{uuid.uuid4().hex}"
            own, array = np.asarray(keys), np.asarray(vectors, np.float32)
            if self.kind == "npy":
                files = {f"{name}{_KEYS}": _saved(own), f"{name}.npy": _saved(array)}
            else:
                files = {f"{name}.pkl": pickle.dumps({"ids": list(keys), "embeddings": array})}
            for file, raw in files.items():
                with system.open_output_stream(f"{path}/{self.job}/{file}") as f:
                    f.write(raw)
                names.append(file)

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key is None or vector is None or (width and len(vector) != width):
                    raise ValueError(f"the vector of {key} is null or not of length {width}")
                width = len(vector)
                keys.append(key)
                vectors.append(vector)
                total += 1
                if len(keys) >= self.rows:
                    put()
                    keys, vectors = [], []
        if keys:
            put()
        return _Written(names, total, width)

    def commit(self, messages: list[_Written | None]) -> None:
        system, path = _place(self.path)
        system.create_dir(f"{path}/{self.job}")
        done = [m for m in messages if m is not None]
        widths = {m.dimensions for m in done if m.rows}
        if len(widths) > 1:
            self.abort(messages)
            raise ValueError(f"vectors of different lengths: {sorted(widths)}")
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path)):
                if f.is_file and f.path.endswith((".npy", ".pkl", "metadata.json")):
                    system.delete_file(f.path)
        for m in done:
            for name in m.names:
                system.move(f"{path}/{self.job}/{name}", f"{path}/{name}")
        meta = {"kind": self.kind, "rows": sum(m.rows for m in done), "dimensions": max(widths, default=0), "files": sum(len(m.names) for m in done)}
        with system.open_output_stream(f"{path}/metadata.json") as f:
            f.write(json.dumps(meta).encode())
        system.delete_dir(f"{path}/{self.job}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, path = _place(self.path)
        if system.get_file_info(f"{path}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/{self.job}")


class EmbeddingFiles(DataSource):
    """The data source ``embedding_files``; options ``path``, ``kind`` and, to write, ``rows``."""

    @classmethod
    def name(cls) -> str:
        return "embedding_files"

    def schema(self) -> str:
        return f"{self.options.get('key', 'id')} {self.options.get('type', 'bigint')}, {self.options.get('vector', 'embedding')} array<float>"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(EmbeddingFiles)
    return spark
