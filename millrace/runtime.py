"""Session, table access and cut points shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    here, tmp = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="millrace-code-")
    atexit.register(shutil.rmtree, tmp, True)  # the driver serves the file as long as the context lives
    out = Path(tmp) / "millrace_workers.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(out))
    sc._millrace_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`; columns are pruned by the plan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else (tests) a temporary one set here."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark, "_millrace_dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark._millrace_dir = root
        spark.sparkContext.setCheckpointDir(root)
        atexit.register(shutil.rmtree, root[len("file://") :], True)
    return root


def _open_folders(spark: SparkSession) -> list[str]:
    """Folders of this session's cut points; they go when the program ends, at the latest."""
    held = getattr(spark, "_millrace_folders", None)
    if held is None:
        held = spark._millrace_folders = []
        atexit.register(sweep, spark)
    return held


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Remove all cut points of the session. Results that were not read or written yet are lost with them."""
    held = getattr(spark, "_millrace_folders", [])
    try:
        while held:
            remove(spark, held.pop())
    except Exception:  # noqa: BLE001
        held.clear()  # the session has ended


class Scratch:
    """Cut points: tables written to the shared folder, so lost executors never lose them.

    Each operator call owns one folder; `drop` removes a table that is no longer needed, `sweep` all folders of a session.
    """

    def __init__(self, spark: SparkSession, what: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _open_folders(spark).append(self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{name}-{self._n}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` and return the table as read back."""
        return self.put_at(df, self.path(name))

    def put_at(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._millrace_path = path
        return out

    def all(self, tables: list[DataFrame]) -> DataFrame:
        """The rows of tables of one schema that `put` returned, as one scan."""
        return self.spark.read.schema(tables[0].schema).parquet(*[t._millrace_path for t in tables])

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t._millrace_path)
