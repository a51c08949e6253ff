"""Session set-up, lineage cuts and size-checked joins shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows below which a side may be broadcast (tens of MB for the narrow tables used here).
BROADCAST_ROWS = 500_000


def session(app: str = "veilgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; SQL settings of the cluster or of ``conf`` win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # call-site capture costs a JVM round trip for every column expression
    fixed = {"spark.ui.showConsoleProgress": "false", "spark.python.sql.dataFrameDebugging.enabled": "false"}
    for key, value in {**fixed, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    given = spark.sparkContext.getConf()
    for key, value in defaults.items():
        if key not in conf and not given.contains(key):
            spark.conf.set(key, value)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Freeze ``df`` in reliable storage, so that later reads see the same rows.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A private folder is
    made only when none is set and the session is local.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder of this session, set as its checkpoint folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="veilgrid-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, in the folder all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame (a global aggregate) to every row of ``df``."""
    packed = one_row.select(F.struct(*one_row.columns).alias("s")).scalar()
    names = one_row.columns
    return df.withColumn("_scalars", packed).select(
        *df.columns, *[F.col("_scalars")[n].alias(n) for n in names]
    )


def attach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join per-group statistics back to the rows; with no keys they are global scalars.

    The keyed join carries no hint: Spark broadcasts ``stats`` only if its measured size is
    under the threshold and otherwise shuffles, splitting skewed keys (adaptive execution).
    """
    if not keys:
        return with_scalars(df, stats)
    return df.join(stats, keys, how)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores before each of them is multiplied or scanned many times.

    A small table comes out of adaptive coalescing in one or two partitions; what is generated
    from it would then run in as many tasks. Large tables keep the number of shuffle partitions.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only if its known row count is under the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def attach_to_rows(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``attach`` for a large ``df``: the statistics are frozen and counted first.

    If they are few they are broadcast, so the rows are not shuffled onto a handful of group keys;
    otherwise the join shuffles.
    """
    if not keys:
        return with_scalars(df, stats)
    frozen = cut(stats)
    return df.join(small_side(frozen, frozen.count()), keys, how)


def explode_specs(df: DataFrame, specs: list[dict], prefix: str = "") -> DataFrame:
    """Repeat each row once per spec (a fixed, short list) without a join."""
    names = list(specs[0])
    entries = [F.struct(*[F.lit(s[n]).alias(prefix + n) for n in names]) for s in specs]
    return df.withColumn("_spec", F.explode(F.array(*entries))).select(
        *df.columns, *[F.col("_spec")[prefix + n].alias(prefix + n) for n in names]
    )
