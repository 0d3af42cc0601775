"""Versions of a set of tables: data in folders that never change, and a manifest a
version, which is swapped in whole or not at all.

A change writes its folders first and then its manifest, under the next number. That
last step fails if the number is taken, so of two writers that began at the same
version one is refused, and a write that fails on its way leaves nothing but folders
that no manifest names. Readers hold on to a version as long as it is kept.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEQ, LAST = "_seq", "_last"


class Conflict(RuntimeError):
    """Another writer has committed since this change began."""


class Files:
    """What the store needs of a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def list(self, name: str) -> list[tuple[str, int]]:
        """(name, time of change in seconds) of what a folder has."""
        folder = self.path(name)
        return [(s.getPath().getName(), s.getModificationTime() // 1000) for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def create(self, name: str, text: str) -> bool:
        """Make a file with this text, whole; False if there is one of that name."""
        own = self.path(f"_tmp/{uuid.uuid4().hex}")
        stream = self.fs.create(own, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        to = self.path(name)
        self.fs.mkdirs(to.getParent())
        try:
            if self.local:  # a rename would replace what is there
                local = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(to), local(own))
            else:
                none = self.jvm.org.apache.hadoop.fs.Options.Rename
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.conf)
                options = self.jvm.java.lang.reflect.Array.newInstance(none.NONE.getClass(), 0)
                context.rename(own, to, options)
            return True
        except Exception as e:
            if self.fs.exists(to):
                return False
            raise e
        finally:
            if self.fs.exists(own):
                self.fs.delete(own, False)


@dataclass
class Manifest:
    """tables: name -> {"schema", "key" (columns), "parts": [{"kind", "seq", "path"}]}.
    kind: rows (added), new (replace rows of the same key), gone (keys removed).
    marks: what a change says about itself, such as a stream's last batch."""

    version: int = 0
    tables: dict = field(default_factory=dict)
    marks: dict = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {p["path"] for t in self.tables.values() for p in t["parts"]}


class Versions:
    """Tables under a folder, in versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.root = self.files.root

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n, _ in self.files.list("_versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """That of a version, by default the latest; an empty one of an empty store."""
        known = self.numbers() if version is None else [version]
        return Manifest(**json.loads(self.files.read(f"_versions/{known[-1]:020d}.json"))) if known and known[-1] else Manifest()

    def names(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version).tables)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as a version has it. Rows that were replaced or removed later are
        left out by their keys; a table without such changes is read as it lies."""
        return self._read(self.manifest(version).tables[name])

    def _read(self, told: dict) -> DataFrame:
        schema, key = StructType.fromJson(told["schema"]), told["key"]
        rows = marks = None
        for p in told["parts"]:
            at = F.lit(p["seq"]).alias(SEQ)
            read = self.spark.read.schema(StructType([schema[k] for k in key]) if p["kind"] == "gone" else schema).parquet(f"{self.root}/{p['path']}")
            if p["kind"] != "gone":
                rows = read.select("*", at) if rows is None else rows.unionByName(read.select("*", at))
            if p["kind"] != "rows":
                marks = read.select(*key, at) if marks is None else marks.unionByName(read.select(*key, at))
        if rows is None:
            return self.spark.createDataFrame([], schema)
        if marks is not None:
            last = marks.groupBy(*key).agg(F.max(SEQ).alias(LAST))
            rows = rows.join(last, key, "left").filter(F.col(LAST).isNull() | (F.col(SEQ) >= F.col(LAST)))
        return rows.select(*schema.names)

    @contextmanager
    def change(self) -> Iterator[Change]:
        """A change of any of the tables, committed at the end of the block; an error
        in it commits nothing. Conflict if another one was committed meanwhile."""
        c = Change(self, self.manifest())
        yield c
        c.commit()

    def compact(self, name: str | None = None, least: int = 2) -> None:
        """Write tables of at least so many parts (or one table) as a single part."""
        with self.change() as c:
            for table, told in c.manifest.tables.items():
                if table == name or name is None and len(told["parts"]) >= least:
                    c.replace(table, self._read(told), told["key"])

    def vacuum(self, keep: int = 1, older: float = 0) -> list[str]:
        """Drop all but the last versions, and the folders that none of them names,
        if they changed at least so many seconds ago, since a change that isn't
        committed yet has such ones too. Returns the folders dropped."""
        numbers = self.numbers()
        stay = {f for n in numbers[-keep:] for f in self.manifest(n).folders()}
        for n in numbers[:-keep]:
            self.files.delete(f"_versions/{n:020d}.json")
        before = time.time() - older
        gone = [f"data/{n}" for n, at in self.files.list("data") if f"data/{n}" not in stay and at <= before]
        for path in gone:
            self.files.delete(path)
        return gone


class Change:
    """Parts written for the next version."""

    def __init__(self, versions: Versions, manifest: Manifest):
        self.versions, self.manifest = versions, manifest
        self.next = manifest.version + 1

    def read(self, name: str) -> DataFrame:
        """A table with the parts of this change."""
        return self.versions._read(self.manifest.tables[name])

    def has(self, name: str) -> bool:
        return name in self.manifest.tables

    def _part(self, name: str, kind: str, df: DataFrame, key: list[str]) -> dict:
        told = self.manifest.tables.setdefault(name, {"schema": json.loads(df.schema.json()), "key": key, "parts": []})
        own = StructType.fromJson(told["schema"])
        wanted = [own[k] for k in key] if kind == "gone" else own
        if key != told["key"] or set(df.columns) < {f.name for f in wanted}:
            raise ValueError(f"{name} has the key {told['key']} and the columns {own.names}")
        path = f"data/{name}-{self.next:08d}-{uuid.uuid4().hex}"
        df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted)).write.parquet(f"{self.versions.root}/{path}")
        # Within one change, later parts hold against earlier ones.
        seq = 1 + max((p["seq"] for p in told["parts"]), default=0)
        told["parts"].append({"kind": kind, "seq": seq, "path": path})
        return told

    def append(self, name: str, df: DataFrame, key: list[str] | None = None) -> None:
        self._part(name, "rows", df, self._key(name, key))

    def upsert(self, name: str, df: DataFrame, key: list[str] | None = None) -> None:
        """Rows of df take the place of those of the same key. Keys without nulls,
        each once in df."""
        self._part(name, "new", df, self._key(name, key))

    def delete(self, name: str, keys: DataFrame) -> None:
        self._part(name, "gone", keys, self._key(name, None))

    def replace(self, name: str, df: DataFrame, key: list[str] | None = None) -> None:
        """df is all that the table has from now on; its columns may be other ones."""
        key = self._key(name, key)
        df = df.select("*")
        self.manifest.tables = {**self.manifest.tables}
        self.manifest.tables.pop(name, None)
        self._part(name, "rows", df, key)

    def _key(self, name: str, key: list[str] | None) -> list[str]:
        return key if key is not None else self.manifest.tables.get(name, {}).get("key", [])

    def mark(self, name: str, value: object) -> None:
        self.manifest.marks[name] = value

    def commit(self) -> int:
        self.manifest.version = self.next
        text = json.dumps({"version": self.next, "tables": self.manifest.tables, "marks": self.manifest.marks})
        if not self.versions.files.create(f"_versions/{self.next:020d}.json", text):
            raise Conflict(f"version {self.next} of {self.versions.root} is another writer's")
        return self.next
