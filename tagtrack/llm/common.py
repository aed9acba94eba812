"""Words, row keys and intermediate tables shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtrack.plans.barrier import fresh_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: what stands between words once A-Z are lower-cased
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is (plain ``lower`` would change É and the Kelvin sign)."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words_of(low: Column) -> Column:
    """The words of a text whose A-Z are lower-cased already."""
    return F.array_remove(F.split(low, GAP), "")


def words(text: Column) -> Column:
    """The words of a text, in order; none for NULL."""
    return words_of(ascii_lower(F.coalesce(text, F.lit(""))))


def text_key(text: Column) -> Column:
    """A value that keeps rows of one id with different texts apart (64-bit hash and length)."""
    return F.struct(F.xxhash64(text).alias("h"), F.coalesce(F.char_length(text), F.lit(-1)).alias("n"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front for as long as the table has such a column (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from the files: a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def starts_of(counts: DataFrame, key: str, block: int = 1024) -> DataFrame:
    """key, start: the sum of ``n`` over all smaller keys of a (key, n) table.

    Running sums inside blocks of keys, then over the blocks: one task sees a row per block only.
    """
    inside = Window.partitionBy("block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "n", F.expr(f"{key} div {block}").alias("block"))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = counts.select(key, "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("own"))
    return rows.join(blocks, "block").select(key, (F.col("base") + F.col("own")).alias("start"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where the optimizer merges projections or moves a filter."""
    return F.get(F.transform(F.array(value), body), 0)
