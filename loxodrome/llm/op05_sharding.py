"""Shards by proportional stratified interleaving.

Rows are shuffled by a seed within each source and ranked; the rank over the source's size, a fraction in [0, 1),
orders all rows, so any run of that order holds every source in proportion. The order is cut into runs whose
row counts are at most one apart (law ``rows``).

Exact ranks without a task that sees a whole source: the seeded hash is uniform, so its leading bits cut a source
into buckets of bounded size. Small per-bucket counts are summed up to offsets, and rows are numbered inside their
bucket only. The fractions are spread evenly too, and the overall position comes about the same way. Each source
starts at a seeded offset within its first step, so that many small sources don't meet at the same fraction.

Only DataFrame functions are used. Defined cases: a null source is a source; a null text has no bytes; equal rows
each get a place; an empty table gives an empty result; other columns are ignored. Rows that equal ``doc_id``
several times are told apart by size and checksum, and rows equal in all of these are exchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loxodrome.llm.frames import narrow
from loxodrome.llm.workspace import Workspace

_TOP = float(1 << 52)


def _uniform(*columns) -> F.Column:
    """A seeded hash as a double in [0, 1): the first 52 bits of MD5, so that other engines draw alike."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(_TOP)


def _numbered(df: DataFrame, keys: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """``out``: each row's number, from 0, within ``keys`` by (``bucket``, ``order``); ``out``_of: rows of ``keys``.

    Rows meet their bucket's offset by an equi-join on the columns that also number them inside the bucket.
    """
    by = [*keys, bucket]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(f"{out}_of"),
    )
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("_inside", inside).join(offsets, by).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def stratified_shards(df: DataFrame, shards: int, seed: int = 17, bucket_rows: int = 512, max_buckets: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot and the source, for every row."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark: SparkSession = df.sparkSession
    work = Workspace(spark)
    d = narrow(df, id_col, text_col, source_col)
    rows = d.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"),
        F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")).alias("crc"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("-")).alias("src"),
        F.col(source_col).alias("source"),
    )
    rows = work.save(rows, "rows")
    total = rows.count()
    buckets = min(max_buckets, max(1, -(-total // bucket_rows)))
    rows = rows.withColumn("h", _uniform(F.lit(seed), F.col("id"), F.col("crc"), F.col("src")))
    rows = rows.withColumn("b", F.floor(F.col("h") * buckets))
    ranked = _numbered(rows, ["src"], "b", ["h", "id", "bytes", "crc"], "rank")
    start = _uniform(F.lit(seed + 1), F.col("src"))
    ranked = ranked.withColumn("fraction", (F.col("rank") + start) / F.col("rank_of"))
    ranked = ranked.withColumn("part", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)))
    ranked = work.save(ranked.select("id", "bytes", "crc", "src", "source", "h", "fraction", "part").withColumn("all", F.lit(0)), "ranked")
    placed = _numbered(ranked, ["all"], "part", ["fraction", "src", "h", "id", "bytes", "crc"], "place")
    placed = placed.withColumn("shard", F.expr(f"place * {shards}L div {max(total, 1)}L").cast("int"))
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")  # the first place of the shard
    return placed.select(
        F.col("id").alias(id_col),
        (F.col("bytes") + 1).alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (F.col("place") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("source").alias(source_col),
    )
