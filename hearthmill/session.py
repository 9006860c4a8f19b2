"""Session helpers: session builder, table access, shared storage.

Nothing here assumes a machine-local disk on a cluster: intermediate tables go
to the folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPING = threading.Lock()


def build_session(app: str = "hearthmill", master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each application.

    Python workers import it to run the Arrow functions; they need not have it installed or on
    their path. The archive lies in the driver's temporary folder only until Spark has taken it.
    Models are built in several threads: one ships while the others wait, since Spark takes a
    file name from one path only.
    """
    sc = spark.sparkContext
    with _SHIPPING:
        if getattr(sc, "_hearthmill_shipped", None) == sc.applicationId:
            return
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="hearthmill-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = Path(folder) / "hearthmill_code.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(archive))
        sc._hearthmill_shipped = sc.applicationId


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root`` (a file or a folder of parts)."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can read and write.

    It is the one named in ``spark.checkpoint.dir``. Only where that is unset
    and the master is local (tests, a laptop) a temporary folder is made; on a
    cluster a missing setting is an error, since a machine-local folder would
    lose data with its machine.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; intermediate tables need a shared folder")
    root = tempfile.mkdtemp(prefix="hearthmill-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    sc.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark)}/hearthmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a scan of what was written.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = new_path(df.sparkSession, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
