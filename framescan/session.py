"""Session helpers.

The library never creates a cluster session behind the caller's back: every
operator takes DataFrames.  ``get_session`` is for tests, the bench and local
runs; on a cluster the caller's session (and its ``spark.checkpoint.dir``)
is used as is.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every query here relies on.
REQUIRED_CONF = {
    # timestamps are compared as UTC instants, like the audit log's ISO text
    "spark.sql.session.timeZone": "UTC",
    # duplicate JSON keys: last one wins, as in Python's json module
    "spark.sql.variant.allowDuplicateKeys": "true",
    # The scan materialises three text views, probe texts and per-rule hit
    # flags as separate projections, and the frame parser materialises the
    # parsed VARIANT; many later columns read them.  Collapsing adjacent
    # projections would re-inline those expressions into every consumer (the
    # regexes and JSON parses then run once per consumer: measured 8x slower
    # on the inspection pipeline).  Whole-stage codegen still fuses the
    # projections into one generated function.
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.CollapseProject",
}


def ship_package(spark: SparkSession) -> None:
    """Make ``framescan`` importable by the Python workers (its UDFs are
    pickled by reference): zip the package on the driver once per
    SparkContext and ``addPyFile`` it; Spark distributes it to executors."""
    sc = spark.sparkContext
    if getattr(sc, "_framescan_shipped", False):
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="framescan-pyfiles-"), "framescan.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    sc._framescan_shipped = True


def apply_required_conf(spark: SparkSession) -> None:
    ship_package(spark)
    for k, v in REQUIRED_CONF.items():
        cur = spark.conf.get(k, None)
        if k == "spark.sql.optimizer.excludedRules" and cur:
            if v in cur.split(","):
                continue
            v = cur + "," + v
        if cur != v:
            spark.conf.set(k, v)


def check_conf(spark: SparkSession) -> None:
    """Refuse a session whose settings would change or never end what follows; nothing is set behind the caller's back."""
    excluded = (spark.conf.get("spark.sql.optimizer.excludedRules", "") or "").split(",")
    wrong = [k for k, v in REQUIRED_CONF.items() if spark.conf.get(k, None) != v and v not in excluded]
    if wrong:
        raise ValueError(f"framescan.session.apply_required_conf(spark) must be called first; these differ: {', '.join(wrong)}")
    ship_package(spark)


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "framescan") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FRAMESCAN_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config("spark.framescan.scan.minPartitions", str(2 * shuffle_partitions))
        .config("spark.sql.optimizer.excludedRules", REQUIRED_CONF["spark.sql.optimizer.excludedRules"])
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_required_conf(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local session that has none (tests) gets a scratch folder; on a
    cluster a folder that all machines share must be set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="framescan-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def written_once(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, its lineage cut:
    what follows reads the files, also after executors are lost."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        checkpoint_dir(df.sparkSession)
    return df.checkpoint()
