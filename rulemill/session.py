"""Session helpers: checkpoint folder, table scans, partition counts and sized broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a keyed side may be broadcast; more go through a shuffled join.
BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's own setting, else one for local runs.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Only where that is unset
    (tests on one machine) a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="rulemill-ckpt-"))
    return named or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` read back from a reliable checkpoint, so that lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of what is no longer referred to be deleted now, not when the driver happens to collect its garbage."""
    for _ in range(2):  # what Python lets go of reaches the JVM a little later
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def semi_join_sized(big: DataFrame, keys: DataFrame, on: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Semi join that broadcasts ``keys`` (already materialised) only if it has at most ``limit`` rows."""
    few = keys.limit(limit + 1).count() <= limit
    return big.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), on, "left_semi")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        spark.sparkContext.addPyFile(package_zip(os.path.join(tempfile.mkdtemp(prefix="rulemill-"), "rulemill.zip")))


def package_zip(path: str) -> str:
    """Write the package's sources as a zip file."""
    root = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    return path
