"""Session helpers: local test sessions and the shared folder for written tables."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lexicept") -> SparkSession:
    """A local session for tests and benchmarks (no UI, AQE on, UTC).

    No more Python workers stay idle than there are cores: a plan with two Python steps starts two a task, and each
    worker that is kept loads its own encoder.
    """
    slots = (os.cpu_count() or 1) if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.factory.idleWorkerMaxPoolSize", str(slots))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors for written tables and checkpoints.

    On a cluster this is whatever ``spark.checkpoint.dir`` names; without it a
    cluster session is refused, because a machine-local folder is not shared.
    A local master has one machine, so a scratch folder serves there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def table_path(spark: SparkSession, name: str) -> str:
    return shared_dir(spark).rstrip("/") + "/tables/" + name


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lexicept`` importable on every executor (``SparkContext.addPyFile``).

    Python UDFs defined in this package are unpickled on executors by module
    name, so the package has to travel with the job, as ``--py-files`` would do.
    The zip is built once per SparkContext in a driver-side temporary folder;
    ``addPyFile`` carries it to the executors.
    """
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="run-ship-"), f"lexicept-{os.getpid()}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for f in pkg.rglob("*.py"):
            zf.write(f, f.relative_to(pkg.parent).as_posix())
    sc.addPyFile(path)
    _SHIPPED.add(key)
