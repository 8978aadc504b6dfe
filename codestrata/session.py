"""Session settings and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; on a cluster use the session given there."""
    b = (
        SparkSession.builder.appName("codestrata")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of a data folder; projections and filters reach the parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the folder the session names, so that losing an executor loses no result.

    The folder is read from `spark.checkpoint.dir`; only where that is unset and the master is local (tests, a single machine) one of
    the machine's is used. On a cluster without that setting it is an error, as a folder of one machine is none of the others'.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = folder or os.path.join(os.environ.get("TMPDIR", "/tmp"), "codestrata-checkpoints")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session, once per context, wherever they run."""
    import hashlib
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_codestrata_shipped", False):
        return
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    mark = hashlib.sha1(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    out = Path(tempfile.mkdtemp(prefix="codestrata-")) / f"codestrata-{mark}.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    sc._codestrata_shipped = True
