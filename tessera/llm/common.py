"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java, RE2 and Python character class.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local session
    takes a new temporary folder, which is then set; a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster's machines need a folder that they share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends
    there, and a lost executor costs no more than rereading files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # The shuffle files behind the table go once it is written.
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


_HELD: dict = {}


def held(key: object, make: Callable[[], object]) -> object:
    """make(), which a worker keeps for its next tasks under key: of all keys only
    the last, since workers outlive a stage and its tables would add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row, even where body uses
    it inside another lambda (a projected column may be inlined there)."""
    return F.transform(F.array(value), body)[0]


def fresh_names(docs: DataFrame, other: DataFrame) -> DataFrame:
    """other with names that docs doesn't have, in the same order."""
    return other.toDF(*fresh(docs, *other.columns))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that docs doesn't have, in whatever case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
