"""What the operators of this subpackage share: words, let-bindings, tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of a word `[^\x20\x09-\x0D]+`, as a Java regex.
SPACES = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_kept: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where it is unset, a local folder serves, and only a
    local master may use that.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended; the folder is scratch space
        pass


@atexit.register
def _clear() -> None:
    for spark, path in _kept:
        _remove(spark, path)


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and return a scan of it.

    Lineage ends at files that outlive any executor, and a branch that is read twice is
    computed once.  The table is removed when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")  # nothing reads this query's shuffles once its table stands
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    _kept.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove a table made by ``durable`` that nothing reads any more."""
    gone = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for spark, path in [x for x in _kept if any(g.rstrip("/").endswith(x[1].split("/lodestone/")[1]) for g in gone)]:
        _remove(spark, path)
        _kept.remove((spark, path))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Inside a lambda a column of an earlier projection may be inlined and computed again for
    each element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def text_of(col: Column | str) -> Column:
    """A text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text that isn't null, in order."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))


def n_words_of(text: Column) -> Column:
    """Their number, as long."""
    return F.size(words_of(text)).cast("long")
