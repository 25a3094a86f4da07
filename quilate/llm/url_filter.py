"""URL filters by a sorted digest array.

Rules ``host/path`` are keyed by the 64-bit xxhash of their text. The sorted
keys, the rules' texts and their verdicts become files that Spark ships to every
executor once; tasks memory-map them, so the array is neither copied into each
Python worker nor limited by its memory. For each batch of URLs the operator
forms the texts of all rules that could fit (every suffix of the host at a label
boundary, every path prefix of a length that some rule has), finds them by one
vectorised binary search, and compares the stored text of each hit, so that a
collision of digests can't block a page.

Edge cases: a null URL or one without ``://`` has an empty host and path and no
rule; a rule with the path ``/`` doesn't fit a URL whose path is empty; empty
tables give empty results; extra columns are carried along untouched, and the
result's own columns replace input columns of the same name (but for the key).
"""

from __future__ import annotations

import atexit
import json
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

#: Host up to the first slash, question mark or hash; path up to the latter two.
_SPLIT = re.compile(r"([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    m = _SPLIT.match(url, at + 3)
    return m[1].translate(_LOWER), m[2]


class DigestArray:
    """Sorted 64-bit keys with their texts, in memory-mapped files."""

    def __init__(self, folder: str, name: str):
        at = lambda part: os.path.join(folder, f"{name}.{part}")
        with open(at("json")) as f:
            about = json.load(f)
        self.path_lengths: list[int] = about["path_lengths"]
        self.default: str = about["default"]
        self.size = about["size"]
        self.keys = np.load(at("keys.npy"), mmap_mode="r")
        self.ends = np.load(at("ends.npy"), mmap_mode="r")
        self.allow = np.load(at("allow.npy"), mmap_mode="r")
        self.texts = np.load(at("texts.npy"), mmap_mode="r")

    @staticmethod
    def build(rules: Iterable[tuple[str, str, str]], folder: str, name: str, default: str = "allow") -> list[str]:
        """Write the files for rules (verdict, host, path); later duplicates of a rule replace earlier ones."""
        verdicts = {(host.translate(_LOWER), path): verdict for verdict, host, path in rules}
        rows = sorted((xxhash.xxh64_intdigest(h + p), (h + p).encode(), v == "allow") for (h, p), v in verdicts.items())
        at = lambda part: os.path.join(folder, f"{name}.{part}")
        np.save(at("keys.npy"), np.array([r[0] for r in rows], np.uint64))
        np.save(at("ends.npy"), np.cumsum([0] + [len(r[1]) for r in rows]).astype(np.int64))
        np.save(at("allow.npy"), np.array([r[2] for r in rows], bool))
        np.save(at("texts.npy"), np.frombuffer(b"".join(r[1] for r in rows) or b" ", np.uint8))
        with open(at("json"), "w") as f:
            json.dump({"path_lengths": sorted({len(p) for _, p in verdicts}), "default": default, "size": len(rows)}, f)
        return [at(part) for part in ("json", "keys.npy", "ends.npy", "allow.npy", "texts.npy")]

    def text(self, i: int) -> bytes:
        return self.texts[self.ends[i] : self.ends[i + 1]].tobytes()

    def find(self, probes: list[str]) -> np.ndarray:
        """Index of the rule of each text, or -1. All rules of one digest are compared."""
        if not probes or not self.size:
            return np.full(len(probes), -1)
        digests = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, digests)
        found = np.full(len(probes), -1)
        for i in np.flatnonzero(self.keys[np.minimum(at, self.size - 1)] == digests):
            k, want = int(at[i]), probes[i].encode("utf-8", "surrogatepass")
            while k < self.size and self.keys[k] == digests[i]:
                if self.text(k) == want:
                    found[i] = k
                    break
                k += 1
        return found

    def probes(self, host: str, path: str) -> list[str]:
        """Texts of the rules that could fit, the longest first."""
        suffixes, at = [host], host.find(".")
        while at >= 0:
            suffixes.append(host[at + 1 :])
            at = host.find(".", at + 1)
        heads = [path[:n] for n in self.path_lengths if n <= len(path)]
        return sorted({s + p for s in suffixes if s for p in heads}, key=len, reverse=True)


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``.

    ``rules``: (verdict, host, path). The longest rule that fits wins; without
    one the array holds nothing against the URL and the verdict is ``default``.
    """
    spark: SparkSession = pages.sparkSession
    name = f"digests-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="digests-")
    # the driver hands the files out as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    for file in DigestArray.build(rules, folder, name, default):
        spark.sparkContext.addFile(file)
    own = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in own or c == url]
    at = kept.index(url)
    source = pages.select(*[f"`{c}`" for c in kept])
    schema = StructType([*source.schema.fields, *(StructField(c, StringType()) for c in own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.getRootDirectory(), name)
        for batch in batches:
            split = [split_url(u) for u in batch.column(at).to_pylist()]
            asked = [array.probes(*x) for x in split]
            flat = [p for ps in asked for p in ps]
            found, begin, rule, verdict = array.find(flat), 0, [], []
            for ps in asked:
                hits = np.flatnonzero(found[begin : begin + len(ps)] >= 0)
                k = int(found[begin + hits[0]]) if len(hits) else -1
                rule.append(ps[hits[0]] if k >= 0 else None)
                verdict.append(("allow" if array.allow[k] else "block") if k >= 0 else array.default)
                begin += len(ps)
            columns = [pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*kept, *own])

    return source.mapInArrow(run, schema)
