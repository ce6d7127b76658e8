"""Session helpers: a tuned local/cluster session and the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Confs that matter for the plans in this package.  They are defaults only:
# a cluster's spark-defaults win because ``getOrCreate`` keeps an existing
# session and we never override a value that is already set.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call sites are not recorded for each of a page expression's parts
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "newsdigest",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only when nothing is configured (unit tests, a laptop) do we fall
    back to a fresh local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="newsdigest-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df):
    """Cut lineage: write ``df`` once to the reliable checkpoint folder and
    continue from the written copy (survives executor loss, keeps later
    plans small).  Used for the page node tables, which feed many branches."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_COLUMNS: dict[tuple[str, str], object] = {}


def session_column(name: str, build):
    """A column that is built once a session: page expressions have thousands of parts, and building one takes the driver
    longer than planning it."""
    key = (SparkSession.active().sparkContext.applicationId, name)
    if key not in _COLUMNS:
        _COLUMNS[key] = build()
    return _COLUMNS[key]
