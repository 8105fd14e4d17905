"""Session helpers: build a local session for tests / bench and locate shared storage.

On a cluster the session is created by the platform; the library only *reads* its
settings.  ``ensure_checkpoint_dir`` honours ``spark.checkpoint.dir`` and falls back to a
fresh scratch folder only under a local master (local runs and tests); a cluster without
the setting is an error.  ``scratch_path`` / ``materialize`` write intermediate tables under
it, and ``ship_package`` makes the package importable by Python workers.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HTML pages are large rows: keep Arrow batches to a bounded size.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "vellum", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench (``local[cores]``)."""
    n = (os.cpu_count() or 8) if cores == "*" else int(cores)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or n)
    # the test tables are one row group each: deal them over the cores (plans.catalog._wide)
    conf["spark.vellum.read.partitions"] = str(n)
    conf["spark.driver.memory"] = os.environ.get("VELLUM_DRIVER_MEMORY", "16g")
    # catalog tables (bucketed pages) default to a scratch folder, not the working dir
    conf["spark.sql.warehouse.dir"] = tempfile.mkdtemp(prefix="vellum-warehouse-")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; under a local master, create one if none is set."""
    configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vellum-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder (for written intermediates)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex}"


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vellum`` importable by Python workers (the ``--py-files`` mechanism).

    Called by the operators that run Python on executors.  Idempotent per context;
    skipped when the package already comes from an archive, or when
    ``spark.vellum.shipPackage=false`` (package installed on the executors).
    """
    sc = spark.sparkContext
    key = sc.applicationId  # one shipment per application
    if key in _SHIPPED:
        return
    if spark.conf.get("spark.vellum.shipPackage", "true").lower() == "false":
        _SHIPPED.add(key)  # installed on the executors already
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(pkg_dir):  # imported from a zip: already shipped
        _SHIPPED.add(key)
        return
    import zipfile
    out_dir = tempfile.mkdtemp(prefix="vellum-pyfiles-")
    zpath = os.path.join(out_dir, "vellum.zip")
    root = os.path.dirname(pkg_dir)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in base:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def materialize(df, name: str = "table"):
    """Cut lineage by writing ``df`` once as Parquet under the shared checkpoint folder.

    Unlike an eager ``checkpoint()`` (one job to count, another to write), the data is
    computed once; the result survives executor loss like any stored table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
