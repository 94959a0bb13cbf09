"""Exact dedup by skew-safe combining, DataFrame operations only.

Three stages, each of which groups by the digest *and* the whole text, so equal digests alone never merge two texts:

1. local: Spark's partial aggregation combines the copies that one map task holds, so a text leaves a task once for
   each salt at most;
2. salted: the copies meet by (digest, text, salt); a group that holds a third of all rows is dealt over all salts;
3. global: the salt winners of a text, at most one for each salt, meet and the largest doc_id wins.

The way back to the members joins by (digest, salt), which the salted stage already lists with each group's winner, so
the hot group is dealt over the salts there too and only narrow columns move.

Defined results: null text counts as empty; a null doc_id loses against any other (a group of null ids keeps null);
repeated rows count in group_size; of equal ids in a group all rows with that id count as kept by the report; texts of any
length are compared whole; a table without rows gives none; columns besides the id and the text are ignored by
the report and carried along by `deduplicate`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.functions.store import saved

#: Groups are dealt over so many salts at least, and over the number of shuffle partitions if that is more.
LEAST_SALTS, MOST_SALTS = 16, 1024


def _salts(spark: SparkSession) -> int:
    return min(MOST_SALTS, max(LEAST_SALTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(docs: DataFrame, text: str, doc_id: str, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        whole.alias("text"),
        digest(whole).alias("digest"),
        F.pmod(F.xxhash64(F.col(f"`{doc_id}`")), F.lit(salts)).cast("int").alias("salt"),
    )


def report(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", digest: Callable[[Column], Column] | None = None, salts: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    `digest` is for tests with colliding digests; any function of the text gives the same result.  The winners are written
    to the shared folder first, so that rows are only told apart by their texts where texts collide."""
    rows = _rows(docs, text, doc_id, digest or _sha256, salts or _salts(docs.sparkSession))
    sha = F.lower(F.hex("digest")) if digest is None else F.sha2("text", 256)
    salted = rows.groupBy("digest", "text", "salt").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    # the salt winners of a digest meet; the next two groupings and the listing need no further exchange
    winners = salted.repartition("digest").groupBy("digest", "text").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts"))
    texts = winners.groupBy("digest").agg(F.collect_list(F.struct("text", "keep_id", "group_size", "salts")).alias("found"))
    listed = (
        texts.select("digest", (F.size("found") > 1).alias("several"), F.explode("found").alias("x"))
        .select("digest", "several", F.when(F.col("several"), F.col("x.text")).alias("text"), "x.keep_id", "x.group_size", F.explode("x.salts").alias("salt"))
    )
    listed = saved(listed, "winners")
    # one text has this digest: the digest stands for the text, and only narrow columns move
    alone = listed.filter("NOT several").select("digest", "salt", "keep_id", "group_size")
    found = rows.select("doc_id", "digest", "salt", sha.alias("text_sha256")).join(alone, ["digest", "salt"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    result = ["doc_id", "keep_id", "group_size", kept, "text_sha256"]
    apart = listed.filter("several").select("digest", "salt", "text", "keep_id", "group_size")
    if apart.isEmpty():
        return found.select(*result)
    # several texts share a digest: their rows are told apart by the text
    rest = rows.select("doc_id", "digest", "salt", "text", sha.alias("text_sha256")).join(apart, ["digest", "salt", "text"])
    return found.unionByName(rest, allowMissingColumns=True).select(*result)


def deduplicate(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", salts: int | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of equal texts the one with the largest doc_id.

    The other columns travel with the winner, so nothing is joined back.  Of rows that repeat a text and a doc_id one
    stays, the one whose other columns hash highest; a null text stays null if the winner's is."""
    names = docs.columns
    hashed = [f"`{f.name}`" for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    payload = F.struct(F.struct(*[F.col(f"`{n}`") for n in names if n != text]).alias("rest"), F.col(f"`{text}`").isNull().alias("absent"))
    rank = F.struct(F.col(f"`{doc_id}`").isNotNull(), F.col(f"`{doc_id}`"), F.xxhash64(*hashed))
    rows = docs.select(whole.alias("w"), _sha256(whole).alias("d"), F.pmod(F.xxhash64(F.col(f"`{doc_id}`")), F.lit(salts or _salts(docs.sparkSession))).alias("s"), payload.alias("p"), rank.alias("r"))
    salted = rows.groupBy("d", "w", "s").agg(F.max_by("p", "r").alias("p"), F.max("r").alias("r"))
    winners = salted.groupBy("d", "w").agg(F.max_by("p", "r").alias("p"))
    stays = F.when(~F.col("p")["absent"], F.col("w"))
    return winners.select(*[(stays if n == text else F.col("p")["rest"][n]).alias(n) for n in names])


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
