"""Session, shared folder and materialised tables.

Iterative operators cut their lineage by writing a table into the folder the cluster names in
``spark.checkpoint.dir``: a written table survives the loss of any executor and, unlike a cached
one, costs no executor memory.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "noticiario", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster the driver program brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a purely local session may fall back to a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="noticiario-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: After a write of so many seconds the driver's garbage is collected at once: only then does Spark remove the files of shuffles that nothing refers to.
LONG = 1.0


def written(df: DataFrame) -> DataFrame:
    """``df`` as a written table: itself, if it is one."""
    return df if getattr(df, "_written_at", None) else Scratch(df.sparkSession, "written").save(df)[0]


class Scratch:
    """Written intermediate tables of one operator run, in a sub-folder of the shared folder.

    ``save`` writes a frame and gives it back as read from the folder, together with the counts
    asked for; what was shuffled for it goes after a later long write, as the table takes its place.
    ``drop`` removes a table no later step reads. What a returned (lazy) frame still reads is removed
    when the driver program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.step = 0
        atexit.register(self.close)

    def save(self, df: DataFrame, **counts) -> tuple[DataFrame, dict]:
        self.step += 1
        path = f"{self.root}/{self.step:03d}"
        watch = Observation()
        exprs = [F.count(F.lit(1)).alias("rows")] + [e.alias(k) for k, e in counts.items()]
        began = time.monotonic()
        df.observe(watch, *exprs).write.parquet(path)
        if time.monotonic() - began >= LONG:
            self.spark._jvm.System.gc()
        back = self.spark.read.schema(df.schema).parquet(path)
        back._written_at = path
        return back, watch.get

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_written_at", None)
            if path:
                df._written_at = None
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone already
            pass
