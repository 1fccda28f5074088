"""Session settings and the shared working folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

_local_base = None
_scratch = {}


def get_spark(app="claimloom", cpus=None, **conf):
    """Session for tests and benchmarks; a cluster brings its own settings.

    Only settings whose right value depends on the machine are set here. AQE
    (on by default) coalesces shuffle partitions and splits skewed joins.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Rows placed by part of a join's keys on both sides are joined where they are.
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
    )
    if cpus:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", str(cpus))
            .config("spark.driver.memory", "12g")
            .config("spark.driver.host", "127.0.0.1")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark):
    """The folder the cluster names in `spark.checkpoint.dir`.

    A temporary folder is used only for a local master with the setting unset.
    """
    global _local_base
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="claimloom-")
    return _local_base


def new_path(spark, name):
    """A fresh path in the application's own part of the shared folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_dir(spark):
    """The application's own folder in the shared one; it is deleted when the driver ends."""
    context = spark.sparkContext
    if context.applicationId not in _scratch:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/claimloom-{uuid.uuid4().hex}")
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _scratch[context.applicationId] = path.toString()
    return _scratch[context.applicationId]


def stored(df, name, **options):
    """`df` written once to the shared folder, by `options` of the writer, and read back.

    For small tables that are derived and then used several times: nothing is
    computed twice, a lost executor loses nothing, and the size is known.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_dense(df, name):
    """`stored` for larger tables: a codec that takes a third less of the disk than the default."""
    return stored(df, name, compression="zstd")
