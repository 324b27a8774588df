"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import fresh_path

#: The words of a text: runs of anything but blank, tab, line ends, vertical tab and form feed.
BLANKS = r"[\x20\x09-\x0D]+"
#: A table of at most so many narrow rows may be sent to every executor.
FEW = 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, no lineage.

    A lost executor costs the tasks it ran, not the steps before. The files stay until the folder is cleaned.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """The whole text; a null text is an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of a text in order; none for a text of blanks."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def few(df: DataFrame, most: int = FEW, entries: str | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is, and the join shuffles.

    Counting stops at the bound; pass a table or a checkpoint, not a long plan. Where rows hold an array, ``entries`` names
    it, and its entries count instead of the rows.
    """
    if entries is not None:
        held = df.agg(F.sum(F.greatest(F.size(entries), F.lit(1)))).first()[0] or 0
        return F.broadcast(df) if held <= most else df
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
