"""Late arrivals: a layout of files by day, of which late rows overwrite whole days.

Early rows are laid out first. Then the layout is made that of all rows, but only
the days are written again in which something changed: where a late row stands now,
or where its sale stood before. Both layouts hold each sale's latest row, each day
sorted and cut into files of the same number of rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, shared_dir

DAY = 86_400_000_000
#: Sales that a task folds before the shuffle before it hands them on.
HELD = 100_000
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _micros(df: DataFrame, name: str) -> Column:
    """Time in microseconds since 1970; of times without a zone, as if in UTC."""
    ntz = isinstance(df.schema[name].dataType, T.TimestampNTZType)
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{name}`)") if ntz else F.unix_micros(name)


def _packed(df: DataFrame) -> DataFrame:
    """df with times as numbers, which Python reads faster and in any year."""
    times = (T.TimestampType, T.TimestampNTZType)
    return df.select(*(_micros(df, f.name).alias(f.name) if isinstance(f.dataType, times) else F.col(f"`{f.name}`") for f in df.schema))


def _unpacked(spark: SparkSession, rdd, schema: T.StructType) -> DataFrame:
    times = (T.TimestampType, T.TimestampNTZType)
    flat = T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, times) else f.dataType) for f in schema])
    df = spark.createDataFrame(rdd, flat, verifySchema=False)
    back = {T.TimestampType: lambda n: F.timestamp_micros(n), T.TimestampNTZType: lambda n: F.expr(f"timestampadd(MICROSECOND, `{n}`, {_EPOCH})")}
    return df.select(*(back[type(f.dataType)](f.name).alias(f.name) if isinstance(f.dataType, times) else F.col(f"`{f.name}`") for f in schema))


def _null_first(value):
    return (value is not None, value)


def with_copies(sales: DataFrame) -> DataFrame:
    """sales and a copy of each row whose sale_id's crc32 h is divisible by 3 and
    whose day by 10: total + 1, sold h % 2 and arrived 1 + h % 97 days later. Nulls
    stay null; rows without a sale_id or a sold_at have no copy."""
    n, h = fresh(sales, "_copy", "_h")
    days = F.floor(_micros(sales, "sold_at") / DAY)
    rows = sales.withColumn(h, F.crc32(F.col("sale_id").cast("string")))
    rows = rows.withColumn(n, F.explode(F.when((F.col(h) % 3 == 0) & (days % 10 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    later = lambda c, d: F.when(F.col(n) == 1, (F.col(c) + F.make_dt_interval(d)).cast(sales.schema[c].dataType)).otherwise(F.col(c))
    return rows.withColumns(
        {"total": F.col("total") + F.col(n), "sold_at": later("sold_at", (F.col(h) % 2).cast("int")), "arrived_at": later("arrived_at", (1 + F.col(h) % 97).cast("int"))}
    ).select(*sales.columns)


def winners(sales: DataFrame, until: str, id_col: str = "sale_id", at_col: str = "arrived_at", sold_col: str = "sold_at") -> tuple[DataFrame, dict[str, str]]:
    """The rows that either layout keeps: sales' columns and, named by the second
    value: day, at_start (in the layout of early rows), at_end (in that of all),
    late, start_day (where a late row's sale stood at the start).

    A first pass over each task's rows keeps, of up to HELD sales at a time, the
    latest early and the latest row, so that a sale of very many rows sends two
    from each task. The secondary sort brings these together by sale, in order of
    arrival; one streaming pass folds both winners. Of rows that arrived together
    the last one by all its values wins; rows without an arrival come before all.
    """
    spark, columns = sales.sparkSession, sales.columns
    i, at, sold = (columns.index(c) for c in (id_col, at_col, sold_col))
    limit = int(datetime.fromisoformat(until).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000
    names = dict(zip(("day", "at_start", "at_end", "late", "start_day"), fresh(sales, "day", "at_start", "at_end", "late", "start_day"), strict=True))

    def early(row) -> bool:
        return row[at] is not None and row[at] < limit

    def later(old, new):
        """The row of the two that arrived last."""
        if old is None or new is None:
            return new if old is None else old
        a, b = _null_first(old[at]), _null_first(new[at])
        return new if b > a or b == a and repr(new) > repr(old) else old

    def folded(rows) -> tuple:
        first = last = None
        for row in rows:
            first, last = later(first, row) if early(row) else first, later(last, row)
        return first, last

    def combined(rows: Iterator) -> Iterator:
        held: dict = {}

        def hand_on() -> Iterator:
            for pair in held.values():
                for row in pair if pair[0] is not pair[1] else pair[:1]:
                    if row is not None:
                        yield (_null_first(row[i]), _null_first(row[at])), row
            held.clear()

        for row in map(tuple, rows):
            first, last = held.get(row[i], (None, None))
            held[row[i]] = later(first, row) if early(row) else first, later(last, row)
            if len(held) >= HELD:
                yield from hand_on()
        yield from hand_on()

    def day(row) -> int:
        return -1 if row[sold] is None else row[sold] // DAY

    def kept(rows: Iterator) -> Iterator:
        for _, group in groupby(rows, lambda kv: kv[0][0]):
            first, last = folded(row for _, row in group)
            if first is last:
                yield (*last, day(last), True, True, False, None)
                continue
            if first is not None:
                yield (*first, day(first), True, False, False, None)
            yield (*last, day(last), False, True, True, None if first is None else day(first))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rdd = (
        _packed(sales).rdd.mapPartitions(combined)
        .repartitionAndSortWithinPartitions(tasks, lambda key: zlib.crc32(repr(key[0]).encode()))
        .mapPartitions(kept)
    )
    added = [(names["day"], T.LongType()), (names["at_start"], T.BooleanType()), (names["at_end"], T.BooleanType()), (names["late"], T.BooleanType()), (names["start_day"], T.LongType())]
    return materialize(_unpacked(spark, rdd, T.StructType([*sales.schema, *(T.StructField(*f) for f in added)])), "winners"), names


def _cuts(rows: DataFrame, per_file: int, day: str, id_col: str, sold_col: str) -> list[tuple]:
    """The first row's (day, sold, id) of each file, in order: as many as the layout
    has files. Rows are dealt by range and numbered in each range and day; counts of
    ranges and days, added up, give every row's place in its day."""
    keys = materialize(
        rows.select(F.col(day).alias("day"), _micros(rows, sold_col).alias("sold"), F.col(id_col).alias("id"))
        .repartitionByRange("day", "sold", "id").withColumn("range", F.spark_partition_id()), "places",
    )
    sizes = keys.groupBy("range", "day").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", "day", (F.sum("n").over(Window.partitionBy("day").orderBy("range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range", "day").orderBy("sold", "id")) - 1
    first = keys.withColumn("in", inside).join(F.broadcast(before), ["range", "day"]).filter((F.col("in") + F.col("before")) % per_file == 0)
    return sorted((tuple(map(_null_first, r)) for r in first.select("day", "sold", "id").collect()))


def lay_out(rows: DataFrame, columns: list[str], root: str, per_file: int, day: str, id_col: str = "sale_id", sold_col: str = "sold_at") -> None:
    """Write rows under root, a folder a day, each day's in files of per_file rows,
    sorted by time and id. Days under root that rows doesn't have stay untouched;
    those it has are replaced as the job commits, so a lost executor or a failed job
    leaves them as they were. One file is one partition of the second secondary
    sort, which one task streams out."""
    spark = rows.sparkSession
    cuts = _cuts(rows, per_file, day, id_col, sold_col)
    if not cuts:
        return
    kept = rows.select(*(F.col(f"`{c}`") for c in [*columns, day]))
    i, d, sold = (kept.columns.index(c) for c in (id_col, day, sold_col))
    rdd = (
        _packed(kept).rdd.map(lambda row: ((_null_first(row[d]), _null_first(row[sold]), _null_first(row[i])), tuple(row)))
        .repartitionAndSortWithinPartitions(len(cuts), lambda key: bisect_right(cuts, key) - 1).values()
    )
    # The writer would sort by day alone, and not stably; rows are in this order.
    ordered = _unpacked(spark, rdd, kept.schema).sortWithinPartitions(day, sold_col, id_col)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(root)


def overwrite(rows: DataFrame, names: dict[str, str], columns: list[str], root: str, per_file: int, **cols) -> DataFrame:
    """Make the layout of early rows under root that of all rows, and return the days
    written again. Days left without rows are removed; their list, like that of the
    days, grows with the calendar alone."""
    spark, day = rows.sparkSession, names["day"]
    days = rows.filter(names["late"]).select(F.explode(F.array(day, names["start_day"])).alias(day)).filter(F.col(day).isNotNull()).distinct()
    days = materialize(days, "days")
    final = rows.filter(names["at_end"]).join(F.broadcast(days), day, "left_semi")
    lay_out(final, columns, root, per_file, day, **cols)
    empty = days.join(final.select(day).distinct(), day, "left_anti").collect()
    jvm = spark.sparkContext._jvm
    for r in empty:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{day}={r[0]}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return days


def files(spark: SparkSession, root: str, schema: T.StructType, rewritten: DataFrame, day: str, id_col: str = "sale_id", at_col: str = "arrived_at", sold_col: str = "sold_at") -> DataFrame:
    """What the files under root hold, a row a file: day, file_no, path, n_rows,
    cents, rows_crc, columns, ids_sha256, rewritten. Rows are read back, put in the
    order of their file, and digested in one streaming pass."""
    full = T.StructType([*schema, T.StructField(day, T.LongType())])
    there = spark.read.schema(full).parquet(root)
    said = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    crc = F.crc32(F.concat_ws(":", said(F.col(id_col)), said(_micros(there, sold_col)), said(_micros(there, at_col))))
    rows = there.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"), F.col(day).alias("day"), said(F.col(id_col)).alias("id"),
        F.coalesce(F.floor(F.col("total") * 100 + 0.5).cast("long"), F.lit(0).cast("long")).alias("cents"), crc.alias("crc"),
    ).repartition("path").sortWithinPartitions("path", "place")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list = []
        path = None

        def end() -> None:
            if path is not None:
                done.append((path, of, n, cents, crc, sha.hexdigest()))

        for batch in batches:
            runs, at = pc.run_end_encode(batch.column("path")), 0
            for stop, name in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                if name != path:
                    end()
                    path, of, n, cents, crc, sha = name, batch.column("day")[at].as_py(), 0, 0, 0, hashlib.sha256()
                part = batch.slice(at, stop - at)
                sha.update(("," * (n > 0) + ",".join(part.column("id").to_pylist())).encode())
                n, cents, crc, at = n + stop - at, cents + pc.sum(part.column("cents")).as_py(), crc + pc.sum(part.column("crc")).as_py(), stop
        end()
        yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, x, strict=True)) for x in done], kinds)

    kinds = pa.schema([("path", pa.string()), ("day", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("ids_sha256", pa.string())])
    out = rows.mapInArrow(digest, "path string, day long, n_rows long, cents long, rows_crc long, ids_sha256 string")
    # Tasks are numbered in the order of their rows, a file is a task's.
    number = F.row_number().over(Window.partitionBy("day").orderBy(F.regexp_extract("path", r"part-(\d+)", 1).cast("long"), "path")) - 1
    named = ",".join(c for path in there.inputFiles()[:1] for c in spark.read.parquet(path).columns)
    again = rewritten.select(F.col(day).alias("day"), F.lit(True).alias("_again"))
    return out.join(F.broadcast(again), "day", "left").select(
        "day", number.cast("long").alias("file_no"), "n_rows", "cents", "rows_crc", "path", F.lit(named).alias("columns"), "ids_sha256", F.coalesce("_again", F.lit(False)).alias("rewritten"),
    )


def late_overwrite(sales: DataFrame, until: str, per_file: int, root: str | None = None) -> DataFrame:
    """Lay out the rows that arrived before until (UTC), overwrite with all rows, and
    describe the files left: files(). root: a folder that doesn't exist yet; by
    default a new one in the shared folder.

    Rows without sold_at are in day -1; without arrived_at they are late and older
    than all others of their sale; rows without a sale_id are one sale. Equal rows
    are one. Further columns are kept, also one named day (the folders' is _day
    then). An empty table leaves an empty layout.

    The shuffles are by sale and by file; what goes to the driver are the first
    keys of the files (rows / per_file + days) and the days.
    """
    spark = sales.sparkSession
    root = root or f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    rows, names = winners(sales, until)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    lay_out(rows.filter(names["at_start"]), sales.columns, root, per_file, names["day"])
    days = overwrite(rows, names, sales.columns, root, per_file)
    return files(spark, root, sales.schema, days, names["day"])
