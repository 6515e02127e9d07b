"""Keyed tables that grow by batches: append-only sorted runs in one folder, merged level by level.

A run is a parquet table in folders by `slot`, a hash of the key, sorted by the key within it; readers take only the
slots they ask for. `fan` runs of one level merge into one of the next, so a row is rewritten once a level and never
because another batch came. A numbered manifest names the runs that count and is put in place by one rename, after the
run it names, so a writer that dies leaves the state before it. Another session opens the same folder and goes on.

Defined cases: an empty batch adds no run; a row given twice is merged by `merge` when read; an empty folder is an empty
table.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import remove

#: Rows of a level-0 run, runs of a level that merge, rows a slot should hold, and most slots.
UNIT, FAN, SLOT_ROWS, MOST_SLOTS = 50_000, 4, 250_000, 4096
#: Bytes of asked keys that are sent to all tasks; more are joined by a shuffle.
SENT_BYTES = 16 << 20


class Runs:
    """A table with `schema` (DDL) and key columns `key` in folder `path`; merge: rows of equal keys to one.

    ranges: number of slots to the slot of a row, where key ranges are wanted instead of hashes.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], merge: Callable[[DataFrame], DataFrame], unit: int = UNIT, fan: int = FAN, ranges: Callable[[int], Column] | None = None):
        self.spark, self.path, self.schema, self.key, self.merge, self.unit, self.fan = spark, path, schema, key, merge, unit, fan
        self.ranges = ranges
        self.version, self.slots, self.runs = -1, 0, []
        self._load()

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self) -> None:
        folder, fs = self._fs(self.path)
        if not fs.exists(folder):
            return
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if numbers:
            self.version = max(numbers)
            p, _ = self._fs(f"{self.path}/manifest-{self.version}.json")
            stream = fs.open(p)
            held = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            self.slots, self.runs = held["slots"], held["runs"]

    def _save(self) -> None:
        tmp, fs = self._fs(f"{self.path}/part-{uuid.uuid4().hex}")
        out = fs.create(tmp)
        out.write(bytearray(json.dumps({"slots": self.slots, "runs": self.runs}).encode()))
        out.close()
        self.version += 1
        final, _ = self._fs(f"{self.path}/manifest-{self.version}.json")
        if not fs.rename(tmp, final):
            raise RuntimeError(f"another writer has added to {self.path}")
        remove(self.spark, f"{self.path}/manifest-{self.version - 2}.json")

    def slot(self) -> Column:
        if self.ranges is not None:
            return self.ranges(self.slots).cast("int")
        return F.pmod(F.xxhash64(*self.key), F.lit(self.slots)).cast("int")

    def _level(self, rows: int) -> int:
        return max(0, math.ceil(math.log(max(rows, 1) / self.unit, self.fan)))

    def _write(self, rows: DataFrame, level: int, n: int | None = None) -> dict | None:
        name = f"run=r{uuid.uuid4().hex[:12]}"
        parts = min(self.slots, int(self.spark.conf.get("spark.sql.shuffle.partitions")) * 4)
        rows.withColumn("slot", self.slot()).repartition(parts, "slot").sortWithinPartitions("slot", *self.key).write.partitionBy("slot").parquet(f"{self.path}/{name}")
        folder, fs = self._fs(f"{self.path}/{name}")
        if not any(x.isDirectory() for x in fs.listStatus(folder)):
            remove(self.spark, f"{self.path}/{name}")
            return None
        n = self._open([name]).count() if n is None else n
        return {"name": name, "rows": n, "level": max(level, self._level(n))}

    def _open(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], f"{self.schema}, run string, slot int")
        return self.spark.read.schema(f"{self.schema}, run string, slot int").option("basePath", self.path).parquet(*[f"{self.path}/{n}" for n in names])

    def append(self, rows: DataFrame, expected: int | None = None, n: int | None = None) -> DataFrame:
        """Add a batch and return it as stored. expected: rows of the whole table some day; sizes the slots, once. n: at most
        so many has the batch, which places its run in a level; counted if not given."""
        if not self.slots:
            expected = expected if expected is not None else 8 * (rows.count() if n is None else n)
            self.slots = max(4, min(MOST_SLOTS, math.ceil(expected / SLOT_ROWS)))
        run = self._write(rows.select(*[c.split()[0] for c in self.schema.split(",")]), 0, n)
        if run is None:
            return self._open([]).drop("run", "slot")
        self.runs.append(run)
        self._save()
        out = self._open([run["name"]]).drop("run", "slot")
        return out

    def compact(self) -> None:
        """Merge every level that has `fan` runs; call when nothing lazy still reads the old runs."""
        while True:
            by: dict[int, list[dict]] = {}
            for r in self.runs:
                by.setdefault(r["level"], []).append(r)
            full = next((v for _, v in sorted(by.items()) if len(v) >= self.fan), None)
            if full is None:
                return
            merged = self._write(self.merge(self._open([r["name"] for r in full]).drop("run", "slot")), full[0]["level"] + 1)
            self.runs = [r for r in self.runs if r not in full] + ([merged] if merged else [])
            self._save()
            for r in full:
                remove(self.spark, f"{self.path}/{r['name']}")

    def raw(self) -> DataFrame:
        """All rows of all runs, not merged."""
        return self._open([r["name"] for r in self.runs]).drop("run", "slot")

    def read(self) -> DataFrame:
        """The merged table."""
        return self.merge(self.raw())

    def asked(self, keys: DataFrame, how: str = "left_semi", width: int = 64, n: int | None = None) -> DataFrame:
        """Stored rows, not merged, of the keys of a table that is written down, so that counting it is cheap, or that has at
        most `n` rows.

        how: `left_semi`, or `inner` to get the columns of both. Only the slots of the keys are read; keys of at most
        SENT_BYTES (`width` bytes each) are sent to the scan, which then shuffles nothing; more are joined.
        """
        if not self.runs:
            return self.raw().join(keys, self.key, how)
        n = keys.count() if n is None else n
        rows = self._open([r["name"] for r in self.runs])
        if n < 4 * self.slots:
            some = [r[0] for r in keys.select(self.slot().alias("s")).distinct().collect()]  # at most `slots` numbers
            if len(some) < self.slots:
                rows = rows.filter(F.col("slot").isin(some))
        side = F.broadcast(keys) if n * width <= SENT_BYTES else keys
        return rows.drop("run", "slot").join(side, self.key, how)
