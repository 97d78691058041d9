"""Every registered plan query against its SQL on DuckDB, and vectors for paths and headers."""

import tarfile

import pytest
from pyspark.sql import functions as F

from archivolt.errors import OffsetError
from archivolt.functions import header as hd
from archivolt.functions import paths as pa
from archivolt.plans import blocks, layout, queries, volumes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canon(df):
    import pandas as pd

    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return None
        return bool(x) if str(x) in ("True", "False") else float(x) if isinstance(x, int | float) or hasattr(x, "dtype") else x

    return sorted(str([plain(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, con, name):
    a, b = queries.Q[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert canon(a) == canon(b)


@pytest.mark.parametrize("n", [1, 2, 8])
def test_layout_does_not_depend_on_partitions(spark, n):
    inv = queries.corpus(spark, SF)
    one = layout.layout(inv).select("arc_path", "start_offset").collect()
    assert sorted(one) == sorted(layout.layout(inv.repartition(n), ranges=n, one_task_rows=0).select("arc_path", "start_offset").collect())
    assert layout.fingerprint(inv) == layout.fingerprint(inv.repartition(n))


def test_resume_points_reach_the_end_of_the_stream(spark):
    got = [r["byte"] for r in queries.Q["resume_volume_check"](spark, SF.replace("0.001", "0.01")).select("byte").collect()]
    end = layout.total_size(queries.tracks(spark, SF.replace("0.001", "0.01"))).first()[0] - 1024
    assert sorted(got) == list(range(0, end, queries.VOLUME)) and end > 3_000_000


def test_large_layout_size_lays_out_its_entries(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.lay, "layout", lambda inv, f=layout.layout: seen.append(inv) or f(inv, one_task_rows=0))
    size, rows = (queries.Q[q](spark, SF) for q in ("large_layout_size", "large_layout"))
    assert len(seen) == 2 and size.first()["n"] == rows.count()


def test_path_vectors(spark):
    rows = [("folder/" + "a" * 101, "component too long"), ("/".join(("a" * 80, "b" * 80, "c" * 80, "d" * 20)), "path too long"), ("/".join(("a" * 90, "b" * 90, "c" * 70)), "path cannot be split"), ("/".join(("a" * 100, "b" * 54, "c" * 99)), None), ("🔥" * 25, None), ("🔥" * 26, "component too long"), ("x/" + "y" * 100, None)]
    df = spark.createDataFrame(rows, "p string, want string")
    name, prefix = pa.ustar_split(F.col("p"))
    got = df.select("p", "want", pa.path_violation(F.col("p")).alias("v"), pa.path_violation(F.col("p"), F.lit(True)).alias("d"), name.alias("n"), prefix.alias("x")).collect()
    assert all(r["v"] == r["want"] for r in got)
    assert {r["p"]: r for r in got}[rows[3][0]]["n"] == "c" * 99 and {r["p"]: r for r in got}[rows[3][0]]["x"] == "a" * 100 + "/" + "b" * 54
    assert {r["p"]: r for r in got}[rows[6][0]]["d"] == "path cannot be split"


def test_globs():
    import re

    for pattern, yes, no in (("*.log", ["a.log", "x/b.log"], ["a.log/x", "a.logs"]), ("sub/*.t[!x]t", ["sub/a.tst", "q/sub/b.tyt"], ["sub/a.txt", "sub/d/a.tst"]), ("name", ["name", "a/name"], ["Name", "names"]), ("a?c", ["abc"], ["a/c", "ac"])):
        assert all(re.search(pa.glob_regex(pattern), p) for p in yes) and not any(re.search(pa.glob_regex(pattern), p) for p in no)


def entry(spark, **over):
    base = {"arc_path": "path/to/file.txt", "size": 100, "mtime": 1700000000, "mode": 0o644, "uid": 0, "gid": 0, "uname": "root", "gname": "root", "is_dir": False, "is_symlink": False, "linkname": ""}
    kinds = "arc_path string, size long, mtime long, mode int, uid long, gid long, uname string, gname string, is_dir boolean, is_symlink boolean, linkname string"
    df = spark.createDataFrame([tuple((base | over).values())], kinds)
    return bytes.fromhex(df.select(hd.header_hex(hd.entry_columns()).alias("h")).first()["h"])


def test_header_vectors(spark):
    over = {"arc_path": "deep/folder/structure/file.txt", "size": 123456, "mode": 0o755, "uid": 4321, "gid": 8765, "uname": "some-user", "gname": "some-group"}
    raw = entry(spark, **over)
    info = tarfile.TarInfo.frombuf(raw, "utf-8", "strict")
    assert len(raw) == 512 and (info.name, info.size, info.mode, info.uid, info.gid, info.uname, info.gname) == tuple(over.values()) and raw[257:262] == b"ustar"
    big = entry(spark, size=10 << 30)
    assert big[124] == 0x80 and tarfile.TarInfo.frombuf(big, "utf-8", "strict").size == 10 << 30
    link = tarfile.TarInfo.frombuf(entry(spark, is_symlink=True, size=0, linkname="ziel/ñ"), "utf-8", "strict")
    assert link.issym() and link.linkname == "ziel/ñ" and entry(spark, is_dir=True, arc_path="my_folder")[:10] == b"my_folder/"
    for bad in ({"is_symlink": True, "linkname": "l" * 101}, {"mtime": -1}, {"uid": 8**7}, {"uname": "u" * 33}, {"arc_path": "/".join(("a" * 90, "b" * 90, "c" * 70))}):
        with pytest.raises(Exception, match="too long|does not fit|cannot be split"):
            entry(spark, **bad)


def test_windows_and_names(spark):
    t = spark.createDataFrame([("x", "x", 10, 110)], "arc_path string, rel_path string, start_offset long, end_offset long")
    got = {r["vol_index"]: (r["state"], r["local_start"], r["local_end"]) for r in volumes.manifest(t, 200, 50).collect()}
    assert got == {0: ("head", 10, 50), 1: ("body", 0, 50), 2: ("tail", 0, 10)}
    with pytest.raises(ValueError):
        volumes.segments(spark, 10, 0)
    with pytest.raises(OffsetError):
        volumes.window_manifest(t, 5, 5, 200)
    with pytest.raises(OffsetError):
        layout.check_offset(200, 200)
    assert volumes.named(0, 5, "n", "0123456789") == "n_01234567.tar.001" == volumes.named(0, 5, "n", "0123456789", "{none}") == volumes.named(0, 5, "n", "0123456789", "{}")
    assert volumes.named(11, 1200, "n", "ff", "{name}-{part}-{total}-{pindex}") == "n-12-1200-0012" and blocks.padding_of(513) == 511
