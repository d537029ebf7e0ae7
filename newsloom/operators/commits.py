"""What counts of a table's folders: a list that is replaced by a new version, or not at all."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class ConflictError(RuntimeError):
    """Another writer has made the version that this one was about to make."""


@dataclass(frozen=True)
class Manifest:
    """A version: folders with rows, with their keys and with summaries to be laid over them, oldest first, and the last batch of each stream."""

    version: int = 0
    rows: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    summaries: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)

    def next(self, **changes) -> Manifest:
        return replace(self, version=self.version + 1, **changes)

    def has(self, batch: tuple[str, int] | None) -> bool:
        return batch is not None and self.batches.get(batch[0], -1) >= batch[1]

    def with_batch(self, batch: tuple[str, int] | None) -> dict[str, int]:
        return {**self.batches, batch[0]: batch[1]} if batch else self.batches


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/commits")
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> Manifest:
    """The newest version. A file without a whole manifest is one that a writer died over; it counts for nothing but its number."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return Manifest()
    found = sorted((status.getPath() for status in files.listStatus(folder)), key=lambda p: p.getName(), reverse=True)
    names = [name for name in found if name.getName().endswith(".json") and not name.getName().startswith(".")]
    for name in names:
        stream = files.open(name)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            read = json.loads(text)
        except ValueError:
            continue
        lists = {part: tuple(read[part]) for part in ("rows", "keys", "summaries")}
        # Numbers used up by dead writers are not used again.
        return Manifest(version=int(names[0].getName()[: -len(".json")]), batches=read["batches"], **lists)
    return Manifest(version=int(names[0].getName()[: -len(".json")]) if names else 0)


def commit(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Make ``manifest`` the newest version, unless one of its number is there: a file is made only where there is none."""
    folder, files = _folder(spark, path)
    name = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{manifest.version:012d}.json")
    try:
        out = files.create(name, False)
    except Py4JJavaError as error:
        if files.exists(name):
            raise ConflictError(f"version {manifest.version} of {path} was made by another writer") from error
        raise
    out.write(bytearray(json.dumps(asdict(manifest)).encode()))
    out.close()
