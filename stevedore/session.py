"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here assumes: AQE re-plans shuffles at run time (coalescing, skew
# splitting, broadcast conversion by measured size), and wall-clock times are UTC.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # Streaming state beside the heap: windows by source may hold many keys.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(
    master: str | None = None,
    app_name: str = "stevedore",
    conf: dict | None = None,
    *,
    hive_metastore: str | None = None,
) -> SparkSession:
    """Build (or fetch) a session with the defaults above; ``conf`` overrides them.

    ``hive_metastore`` switches the catalog to Hive: a ``thrift://host:port`` URI names
    a shared metastore service; ``"embedded"`` keeps an in-process Derby metastore
    (its files go where ``javax.jdo.option.ConnectionURL`` in ``conf`` points).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULT_CONF, **(conf or {})}
    if hive_metastore:
        builder = builder.enableHiveSupport()
        if hive_metastore != "embedded":
            settings["spark.hadoop.hive.metastore.uris"] = hive_metastore
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when a session on a local master has none (a test) is a private one created and
    registered, so ``DataFrame.checkpoint()`` and our staging paths agree.  On a cluster a
    machine's own folder would hold only what its tasks wrote: RuntimeError.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current.rstrip("/")
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="stevedore-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the scratch root (one per call, never reused)."""
    return f"{scratch_root(spark)}/stevedore/{name}-{uuid.uuid4().hex[:12]}"
