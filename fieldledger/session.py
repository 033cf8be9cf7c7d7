"""Sessions, table access and the shared folder for intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_DIR_KEY = "spark.checkpoint.dir"


def build_session(cpus: int | str = "*", app: str = "fieldledger", **conf) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_fieldledger_shipped", False):
        return
    context._fieldledger_shipped = True
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="fieldledger-code-")) / "fieldledger.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only where one machine runs all and the session names none."""
    context = spark.sparkContext
    found = spark.conf.get(SHARED_DIR_KEY, None) or context.getConf().get(SHARED_DIR_KEY)
    if found:
        return found
    if not context.master.startswith("local"):
        raise ValueError(f"set {SHARED_DIR_KEY} to a folder that the driver and all executors share")
    if not getattr(context, "_fieldledger_shared", None):
        context._fieldledger_shared = tempfile.mkdtemp(prefix="fieldledger-")
        atexit.register(shutil.rmtree, context._fieldledger_shared, ignore_errors=True)
    return context._fieldledger_shared


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, path: str | None = None, add_row: bool = False, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: a cut in the lineage that lost executors do not undo.

    add_row gives each row a number of its own, the same at each later reading. What is written stays until the
    application ends, or drop_path() takes it: a result may be read at any time after the call.
    """
    spark = df.sparkSession
    ship(spark)
    df = df.withColumn("row", F.monotonically_increasing_id()) if add_row else df
    path = path or fresh_path(spark, label)
    df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """row (a number of its own) and doc (the row as it came), stored: a row's identity where ids are null or repeat."""
    return materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), label, add_row=True, compression="zstd")


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that fresh_path() named, through the file system it lies on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Hints a broadcast only where the counted rows are under the limit; beyond it Spark joins by shuffling."""
    return F.broadcast(df) if rows <= limit else df


#: Rows of one key that a task joins, about, where keys may be hot.
HOT = 20_000


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], row: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """many joined (inner or left) with few, whose keys are unique; counts: keys and uses, how many rows of many have each.

    A key with more than HOT rows is dealt over several tasks: its rows by a hash of row, its one partner to each of them.
    """
    hot = materialize(counts.filter(F.col("uses") > HOT).select(*keys, F.ceil(F.col("uses") / HOT).alias("_salts")), "hot-keys")
    hot = broadcast_if_small(hot, hot.count())
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    salted = many.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(row), salts)).drop("_salts")
    wide = few.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts")
    return salted.join(wide, [*keys, "_salt"], how).drop("_salt")
