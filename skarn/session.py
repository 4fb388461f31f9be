"""Session factory, table access and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_written: list[tuple[SparkSession, str]] = []


def get_session(app: str = "skarn", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; on a cluster pass your own session instead."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it wherever
    they start; the archive is a few hundred KB."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already imported from an archive
        return
    archive = Path(tempfile.mkdtemp(prefix="skarn-package-")) / f"skarn-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir where the cluster sets it.

    Only a local master may fall back to a temporary folder of this machine.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="skarn-checkpoint-")
    sc.setCheckpointDir(at)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _drop_written() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session is gone: the folder's owner cleans up
            return


atexit.register(_drop_written)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back: short lineage, survives lost executors.

    Parquet rather than a row checkpoint, so that the copy is compressed, column-pruned on reading, and its size is
    known to the planner.
    """
    return _cut(df, name)


def _cut(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    removed_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def cut_counted(df: DataFrame, name: str, *aggregates: Column) -> tuple[DataFrame, dict]:
    """The same, with the number of rows (n) and further aggregates over them, which the writing job itself takes, so that a
    loop needs no second job."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = _cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *aggregates), name)
    return out, seen.get


def removed_at_exit(spark: SparkSession, path: str) -> None:
    _written.append((spark, path))


def drop(df: DataFrame) -> None:
    """Remove a table that :func:`cut` wrote and that no plan still to run reads."""
    path = getattr(df, "written_to", None)
    for i, (spark, p) in enumerate(_written):
        if p == path:
            _remove(spark, p)
            del _written[i]
            return


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
