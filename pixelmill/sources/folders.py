"""Folders of image files and bundles of sprite files, as Spark data sources.

``sprite_files`` reads: a partition is a folder (or a share of one), or ``FOLDERS`` top folders with all below them where there are more than those, so that the
driver lists folders, tasks list files, and a task has more to do than to start. Conditions on folder, name and
time are options, checked before a file is opened, and files are opened only if the schema asks for ``content``. (Spark 4.1 keeps the filters that it
pushes to a Python source with the table they were first pushed to: the next query of the same DataFrame would lose rows. So none are taken from there.)

``sprite_bundles`` writes rows (bundle, name, content) as folders of files with a manifest. Tasks write beside the target; only when all of them have
ended does the driver put the bundles in place, each by one rename, and a failure before or meanwhile leaves what was there before.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .images import MEDIA, MOST_BYTES

MANIFEST = "manifest.json"
FILES = "folder string, name string, path string, length bigint, modified timestamp, content binary, error string"
BUNDLES = "bundle string, name string, content binary"
#: Bytes of files that a reader hands on at once.
CHUNK = 16 << 20
#: Top folders that a partition walks, where a path has more than these.
FOLDERS = 32

def _time(text: str | None) -> datetime | None:
    found = datetime.fromisoformat(text) if text else None
    return found.replace(tzinfo=UTC) if found and found.tzinfo is None else found


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    found, base = fs.FileSystem.from_uri(path)
    return found, base.rstrip("/")


@dataclass
class Share(ds.InputPartition):
    """Files of folders, and of those ``below`` them, whose names fall into one of ``of`` shares."""

    folders: list[str]
    number: int = 0
    of: int = 1
    below: bool = False


class FilesReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.shares, self.most = int(options.get("shares", 1)), int(options.get("most_bytes", MOST_BYTES))
        self.media = options.get("media", ",".join(MEDIA)).split(",")
        self.folder, self.prefix, self.suffix = options.get("folder"), options.get("prefix", ""), options.get("suffix", "")
        self.since, self.before = (_time(options.get(c)) for c in ("since", "before"))

    def _below(self, name: str, recursive: bool) -> list[str]:
        """Folders below a folder, without hidden ones and what is in them."""
        store, base = _opened(self.path)
        found = store.get_file_info(fs.FileSelector(f"{base}/{name}".rstrip("/"), recursive=recursive, allow_not_found=True))
        names = sorted(x.path[len(base) :].strip("/") for x in found if x.type == fs.FileType.Directory)
        return [n for n in names if not any(part.startswith(".") for part in n.split("/"))]

    def partitions(self) -> list[Share]:
        top = self._below("", recursive=False)
        if len(top) > FOLDERS and self.folder is None:
            packs = [([""], False), *((top[i : i + FOLDERS], True) for i in range(0, len(top), FOLDERS))]
        else:
            packs = [([n], False) for n in ["", *self._below("", recursive=True)] if self.folder in (None, n)]
        return [Share(names, k, self.shares, below) for names, below in packs for k in range(self.shares)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for top in partition.folders:
            for folder in [top, *(self._below(top, recursive=True) if partition.below else [])]:
                yield from self._read(folder, partition)

    def _read(self, folder: str, partition: Share) -> Iterator[pa.RecordBatch]:
        store, base = _opened(self.path)
        held, size = [], 0
        for info in sorted(store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)), key=lambda x: x.base_name):
            name = info.base_name
            if info.type != fs.FileType.File or "." + info.extension.lower() not in self.media or name.startswith("."):
                continue
            if partition.of > 1 and int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") % partition.of != partition.number:
                continue
            modified = info.mtime.astimezone(UTC)
            if not name.startswith(self.prefix) or not name.endswith(self.suffix) or (self.since and modified < self.since) or (self.before and modified >= self.before):
                continue
            row = {"folder": folder, "name": name, "path": info.path, "length": info.size, "modified": modified, "content": None, "error": None}
            if "content" in self.schema.names:
                if info.size > self.most:
                    row["error"] = "too large"
                else:
                    with store.open_input_stream(info.path) as file:
                        row["content"] = file.read()
                    size += info.size
            held.append(row)
            if size >= CHUNK or len(held) >= 10_000:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"length": pa.int64(), "modified": pa.timestamp("us", "UTC"), "content": pa.binary()}
        return pa.record_batch([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.schema.names], names=self.schema.names)


class SpriteFiles(ds.DataSource):
    """Image files under a path.

    Options: ``folder`` (one alone), ``prefix`` and ``suffix`` of names, ``since`` and ``before`` (times in ISO form, UTC unless they say so),
    ``shares`` that a folder is read in, ``most_bytes`` of a file that is opened, ``media`` (endings).
    """

    @classmethod
    def name(cls) -> str:
        return "sprite_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> FilesReader:
        return FilesReader(self.options, schema)


@dataclass
class Staged(ds.WriterCommitMessage):
    """The bundles that a task wrote, under its own folder."""

    folder: str
    bundles: list[str]


class BundlesWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.stage = f".stage-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, base = _opened(self.path)
        folder = f"{self.stage}/{uuid.uuid4().hex}"  # an attempt that fails or comes twice leaves its own
        done: list[str] = []
        files: dict[str, dict] = {}
        made: set[str] = set()

        def close() -> None:
            with store.open_output_stream(f"{base}/{folder}/{done[-1]}/{MANIFEST}") as out:
                out.write(json.dumps({"bundle": done[-1], "files": list(files.values())}, ensure_ascii=False).encode())
            files.clear()

        for batch in iterator:
            for bundle, name, content in zip(*(batch.column(c) for c in ("bundle", "name", "content")), strict=True):
                bundle, name, content = bundle.as_py(), name.as_py(), content.as_py()
                for part in (bundle, *(name or "").split("/")):
                    if not part or part.startswith("."):
                        raise ValueError(f"no name of a file: {bundle!r}, {name!r}")
                if not done or done[-1] != bundle:
                    if done:
                        close()
                    if bundle in done or "/" in bundle:
                        raise ValueError(f"the files of bundle {bundle!r} do not come together")
                    done.append(bundle)
                    made.clear()
                if name in files or name == MANIFEST:
                    raise ValueError(f"bundle {bundle!r} has two files {name!r}")
                target = f"{base}/{folder}/{bundle}/{name}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(target) as out:
                    out.write(content or b"")
                files[name] = {"name": name, "bytes": len(content or b""), "sha256": hashlib.sha256(content or b"").hexdigest()}
        if done:
            close()
        return Staged(folder, done)

    def commit(self, messages: list[Staged | None]) -> None:
        store, base = _opened(self.path)
        staged = [(m.folder, b) for m in messages if m for b in m.bundles]
        if len({b for _, b in staged}) < len(staged):
            raise ValueError("a bundle's files were written by two tasks; deal them out by bundle")
        there = {x.base_name for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True))}
        old = f"{base}/{self.stage}/old"
        moved, new = [], []
        store.create_dir(old, recursive=True)
        try:
            for name in (there if self.overwrite else there & {b for _, b in staged}) - {self.stage}:
                if not name.startswith("."):
                    store.move(f"{base}/{name}", f"{old}/{name}")
                    moved.append(name)
            for folder, bundle in staged:
                store.move(f"{base}/{folder}/{bundle}", f"{base}/{bundle}")
                new.append(bundle)
        except BaseException:
            for bundle in new:
                store.delete_dir(f"{base}/{bundle}")
            for name in moved:
                store.move(f"{old}/{name}", f"{base}/{name}")
            raise
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """What was staged goes; what is in place stays."""
        store, base = _opened(self.path)
        if store.get_file_info(f"{base}/{self.stage}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.stage}")


class SpriteBundles(ds.DataSource):
    """Bundles of files. ``append`` replaces bundles of the same names and keeps the others, ``overwrite`` keeps none."""

    @classmethod
    def name(cls) -> str:
        return "sprite_bundles"

    def schema(self) -> str:
        return BUNDLES

    def writer(self, schema: StructType, overwrite: bool) -> BundlesWriter:
        return BundlesWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session."""
    for source in (SpriteFiles, SpriteBundles):
        spark.dataSource.register(source)


def files(spark: SparkSession, path: str, content: bool = True, **options: object) -> DataFrame:
    """(folder, name, path, length, modified[, content, error]) of the image files under ``path``; ``folder`` is relative to it. See ``SpriteFiles`` for ``options``."""
    register(spark)
    wanted = FILES if content else FILES.split(", content")[0]
    return spark.read.format("sprite_files").schema(wanted).options(**options).load(path)


def write_bundles(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """(bundle, name, content) rows as folders under ``path``: all of them, or nothing."""
    register(rows.sparkSession)
    dealt = rows.select("bundle", "name", "content").repartition("bundle").sortWithinPartitions("bundle", "name")
    dealt.write.format("sprite_bundles").mode("overwrite" if overwrite else "append").save(path)


def listing(found: DataFrame, most: int | None = None, newest_first: bool = False) -> DataFrame:
    """Each folder's first ``most`` files by name (None: all), then by name, or newest first."""
    from pyspark.sql.window import Window

    if most is not None:
        rank = F.row_number().over(Window.partitionBy("folder").orderBy("name"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
    return found.orderBy("folder", *((F.desc("modified"), "name") if newest_first else ("name",)))


def frame_counts(found: DataFrame, stem: str = "frame-") -> DataFrame:
    """(folder, n): how many PNG files with the stem a folder has."""
    return found.where(F.col("name").startswith(stem) & F.lower("name").endswith(".png")).groupBy("folder").agg(F.count("*").alias("n"))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, name, bytes, sha256): what the manifests under ``path`` say."""
    read = spark.read.text(f"{path}/*/{MANIFEST}", wholetext=True)
    listed = read.select(F.from_json("value", "bundle string, files array<struct<name:string,bytes:bigint,sha256:string>>").alias("v"))
    return listed.select("v.bundle", F.explode("v.files").alias("f")).select("bundle", "f.*")
