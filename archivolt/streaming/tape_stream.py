"""A streaming source whose offset is a byte: it resumes where its checkpoint says, without gap or repeat."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.content import read_range

SCHEMA = "g_start long, g_end long, kind string, arc_path string, data binary"


class _Range(InputPartition):
    def __init__(self, rows: list):
        self.rows = rows


class _Reader(DataSourceStreamReader):
    """The plan is a JSON lines file of block rows by g_start, written by `write_plan`."""

    def __init__(self, options):
        self.plan, self.root = options["plan"], options.get("root", "")
        self.first, self.step = int(options.get("start", 0)), int(options.get("bytesPerBatch", 8 << 20))
        self.at = self.first
        with open(self.plan + ".total") as f:
            self.total = int(f.read())

    def initialOffset(self):
        return {"byte": self.first}

    def latestOffset(self):
        self.at = min(self.at + self.step, self.total)
        return {"byte": self.at}

    def partitions(self, start, end):
        a, b = start["byte"], end["byte"]
        self.at = max(self.at, b)
        rows, parts, size = [], [], 0
        with open(self.plan) as f:
            for line in f:
                r = json.loads(line)
                if r["g_end"] <= a:
                    continue
                if r["g_start"] >= b:
                    break
                lo, hi = max(r["g_start"], a), min(r["g_end"], b)
                rows.append(r | {"lo": lo, "hi": hi})
                size += hi - lo
                if size >= 1 << 20:
                    parts.append(_Range(rows))
                    rows, size = [], 0
        return [*parts, _Range(rows)] if rows else parts

    def read(self, partition):
        for r in partition.rows:
            skip, n = r["lo"] - r["g_start"], r["hi"] - r["lo"]
            if r["kind"] == "header":
                data = bytes.fromhex(r["header"])[skip : skip + n]
            elif r["kind"] == "body":
                data = read_range(self.root, r["rel_path"], r["src_offset"] + skip, n, r["t_size"], r["t_mtime"], r["arc_path"])
            else:
                data = bytes(n)
            yield (r["lo"], r["hi"], r["kind"], r.get("arc_path"), data)

    def commit(self, end):
        pass


class ByteStream(DataSource):
    @classmethod
    def name(cls):
        return "archive_stream"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return _Reader(self.options)


def write_plan(blocks_with_headers: DataFrame, path: str) -> str:
    """The plan's rows, in order, as a file that driver and executors share."""
    total = 0
    with open(path + ".part", "w") as f:
        for row in blocks_with_headers.orderBy("g_start").toLocalIterator():
            f.write(json.dumps(row.asDict()) + "\n")
            total = max(total, row["g_end"])
    with open(path + ".total", "w") as f:
        f.write(str(total))
    os.replace(path + ".part", path)
    return path


def read_stream(spark: SparkSession, plan: str, root: str, start: int = 0, bytes_per_batch: int = 8 << 20) -> DataFrame:
    spark.dataSource.register(ByteStream)
    return spark.readStream.format("archive_stream").options(plan=plan, root=root, start=str(start), bytesPerBatch=str(bytes_per_batch)).load()
