import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest

from tessera.llm import late_rows, queries

EPOCH, UNTIL = datetime(1970, 1, 1), datetime(2024, 3, 1)
SCHEMA = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, day string"


def micros(t):
    return "" if t is None else str((t - EPOCH) // timedelta(microseconds=1))


def day(t):
    return -1 if t is None else (t - EPOCH).days


def copies(rows):
    out = list(rows)
    for r in rows:
        h = zlib.crc32(str(r[0]).encode())
        if r[0] is not None and r[4] is not None and h % 3 == 0 and day(r[4]) % 10 == 0:
            out.append((*r[:3], None if r[3] is None else r[3] + 1, r[4] + timedelta(days=h % 2), None if r[5] is None else r[5] + timedelta(days=1 + h % 97), *r[6:]))
    return out


def layout(rows, per_file):
    """day -> its files' rows, and each sale's row."""
    latest = {}
    for r in rows:
        old = latest.get(r[0])
        if old is None or (r[5] is not None, r[5] or EPOCH) > (old[5] is not None, old[5] or EPOCH):
            latest[r[0]] = r
    days = defaultdict(list)
    for r in latest.values():
        days[day(r[4])].append(r)
    for d, x in days.items():
        x.sort(key=lambda r: (r[4] or EPOCH, r[0] is not None, r[0] or 0))
        days[d] = [x[i : i + per_file] for i in range(0, len(x), per_file)]
    return days, latest


def expected(rows, per_file, columns):
    early = [r for r in rows if r[5] is not None and r[5] < UNTIL]
    start, stood = layout(early, per_file)
    final, latest = layout(rows, per_file)
    touched = set()
    for s, r in latest.items():
        if r[5] is None or r[5] >= UNTIL:
            touched |= {day(r[4])} | ({day(stood[s][4])} if s in stood else set())
    out = []
    for d, parts in (final | {d: p for d, p in start.items() if d not in touched}).items():
        for n, part in enumerate(parts):
            crc = sum(zlib.crc32(f"{'' if r[0] is None else r[0]}:{micros(r[4])}:{micros(r[5])}".encode()) for r in part)
            cents = sum(0 if r[3] is None else math.floor(100 * r[3] + 0.5) for r in part)
            ids = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in part).encode()).hexdigest()
            out.append((d, n, len(part), cents, crc, columns, ids, d in touched))
    return Counter(out), start, touched


def on_disk(root):
    found = {}
    for top, _, names in os.walk(root.removeprefix("file://")):
        for n in names:
            if n.endswith(".parquet") and not n.startswith("."):
                with open(f"{top}/{n}", "rb") as f:
                    found[f"{top}/{n}"] = f.read()
    return found


def plain(rows):
    return Counter((r["day"], r["file_no"], r["n_rows"], r["cents"], r["rows_crc"], r["columns"], r["ids_sha256"], r["rewritten"]) for r in rows)


def messy():
    t = lambda d, s=0: datetime(2024, 1, 1) + timedelta(days=d, seconds=s)
    rows = [(i % 40, i, "open", [1.5, None, -2.005, 1e9][i % 4], t(i % 7, i % 3) if i % 11 else None, t(i % 90, i) if i % 13 else None, i % 5, "x") for i in range(300)]
    rows += [(900, 1, None, 5.0, t(50), t(51), 1, "y"), (900, 1, None, 6.0, t(9), t(80), 1, "y"), (901, 1, "done", 1.0, datetime(1969, 12, 30, 5), t(1), None, None)]
    return [*rows, rows[5], rows[301], (None, 1, "open", 2.0, t(3), t(4), 1, "n")]


def test_layout_matches_brute_force(spark, tmp_path):
    rows = messy()
    sales = spark.createDataFrame(rows, SCHEMA)
    root = f"file://{tmp_path}/layout"
    every = copies(rows)
    assert Counter(map(tuple, late_rows.with_copies(sales).collect())) == Counter(every)
    want, start, touched = expected(every, 4, ",".join(sales.columns))
    winners, names = late_rows.winners(late_rows.with_copies(sales), "2024-03-01")
    late_rows.lay_out(winners.filter(names["at_start"]), sales.columns, root, 4, names["day"])
    before = on_disk(root)
    assert Counter(len(x) for x in start.values()) == Counter(Counter(os.path.dirname(f) for f in before).values())
    days = late_rows.overwrite(winners, names, sales.columns, root, 4)
    assert {r[0] for r in days.collect()} == touched and touched and 19773 in touched
    after = on_disk(root)
    same = {f for f in before if f in after}
    assert all(before[f] == after[f] for f in same)
    got = late_rows.files(spark, root, sales.schema, days, names["day"]).collect()
    assert plain(got) == want
    path = lambda p: p.replace("file:", "").replace("//", "/").replace("//", "/")
    assert {path(r["path"]) for r in got} == set(after)
    assert {path(r["path"]) for r in got if not r["rewritten"]} == same
    assert not any(f"/_day={d}/" in f for f in after for d in touched - {r["day"] for r in got})
    for r in got:
        t = pq.ParquetFile(path(r["path"])).read()
        assert t.column_names == sales.columns and hashlib.sha256(",".join("" if x is None else str(x) for x in t["sale_id"].to_pylist()).encode()).hexdigest() == r["ids_sha256"]


def test_hot_sale_sends_two_rows_a_task(spark, monkeypatch):
    rows = [(1, i, "open", 1.0, datetime(2024, 1, 1 + i % 9), datetime(2024, 1, 1) + timedelta(hours=i % 3000), 1, None) for i in range(5000)]
    winners, names = late_rows.winners(spark.createDataFrame(rows, SCHEMA).repartition(4), "2024-03-01")
    got = winners.collect()
    assert sorted((r["arrived_at"], r[names["at_start"]], r[names["at_end"]]) for r in got) == [(datetime(2024, 2, 29, 23), True, False), (datetime(2024, 1, 1) + timedelta(hours=2999), False, True)]


def test_query_and_empty_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/sales.parquet").collect()]
    got = queries.queries()["op12_late_overwrite"](spark, sf_dir).collect()
    want, _, _ = expected(copies(rows), 1 + len(rows) // 900, "sale_id,client_id,status,total,sold_at,arrived_at,priority")
    assert plain(got) == want and {r["rewritten"] for r in got} == {True, False}
    assert late_rows.late_overwrite(late_rows.with_copies(spark.createDataFrame([], SCHEMA)), "2024-03-01", 5).collect() == []


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_times_are_utc_in_any_session(spark, zone):
    rows = [(3, 1, "open", 1.0, datetime(2024, 1, 10, 23, 59), datetime(2024, 2, 29, 23, 59, 59), 1, None)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        winners, names = late_rows.winners(spark.createDataFrame(rows, SCHEMA), "2024-03-01")
        assert [(r[names["day"]], r["sold_at"], r[names["late"]]) for r in winners.collect()] == [(19732, rows[0][4], False)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
