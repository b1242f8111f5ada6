"""Near duplicates by banded minimum hashes, with sets compared exactly before two texts count as near."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..tables import settle
from .graph import components

#: Sets of one bucket that are compared with each other; a larger bucket is dealt to several such blocks.
BLOCK = 32


def shingle_hashes(text: Column | str, words: int = 5) -> Column:
    """Distinct 64-bit hashes of the runs of so many words of a text, whatever their case; of all words if they are fewer, none without any."""

    def runs(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(own) - (words - 1), F.lit(1)))
        return F.when(F.size(own) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(own, i, F.lit(words)), " ")))))

    return C.let(F.filter(F.split(F.lower(F.coalesce(C.col(text), F.lit(""))), r"\s+"), lambda w: w != ""), runs)


def band_keys(hashes: Column | str, bands: int, rows: int) -> Column:
    """A key for each band: of so many minima, each of the hashes hashed again with a number of its own."""

    def again(k: int):
        return lambda x: F.xxhash64(x, F.lit(k))

    least = [F.array_min(F.transform(C.col(hashes), again(k))) for k in range(bands * rows)]
    return F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*least[b * rows : (b + 1) * rows]).alias("key")) for b in range(bands)])


def near_links(sets: DataFrame, percent: int = 75, bands: int = 8, rows: int = 3, block: int = BLOCK) -> DataFrame:
    """src, dst of two sets(node, hashes) whose intersection is so large a part of their union, among those that share a band.

    A bucket of more than block sets, such as a template's, is dealt to blocks by hash: in each, sets are
    compared with each other and with the bucket's first, so rows grow with sets, and near sets of one
    bucket that aren't compared meet in other bands or through others.
    """
    keyed = sets.select("node", F.explode(band_keys("hashes", bands, rows)).alias("k")).select("node", "k.*")
    buckets = settle(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).where("size > 1"), "near-buckets")
    deal = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("size") / block))
    placed = settle(keyed.join(buckets, ["band", "key"]).select("node", "band", "key", deal.alias("deal"), "first"), "near-placed")
    other = placed.select(F.col("node").alias("other"), "band", "key", "deal")
    pairs = placed.join(other, ["band", "key", "deal"]).where("node < other").select("node", "other")
    firsts = placed.where("first < node").select(F.col("first").alias("node"), F.col("node").alias("other"))
    pairs = settle(pairs.unionByName(firsts).distinct(), "near-pairs")
    held = pairs.join(sets, "node").join(sets.select(F.col("node").alias("other"), F.col("hashes").alias("others")), "other")
    both = F.size(F.array_intersect("hashes", "others"))
    return held.where(100 * both >= percent * (F.size("hashes") + F.size("others") - both)).select(F.col("node").alias("src"), F.col("other").alias("dst"))


def duplicates_near(docs: DataFrame, id_col: str = "path", text_col: str = "text", *, words: int = 5, percent: int = 75, **how) -> DataFrame:
    """id_col, class_id: the texts that are near another one, by the least id that links of near texts lead to.

    Texts of equal shingle sets are one node, so copies are never compared. What is given out is near
    beyond doubt, since sets are compared whole; a pair of exactly percent shares one of eight bands of
    three with a probability of 0.987, a closer one with more.
    """
    own = docs.select(F.col(id_col).alias("id"), shingle_hashes(text_col, words).alias("hashes")).where("size(hashes) > 0")
    own = own.withColumn("set_key", F.struct(F.xxhash64(F.array_sort("hashes")), F.xxhash64(F.array_sort("hashes"), F.size("hashes"))))
    own = settle(own, "near-sets")
    nodes = settle(own.groupBy("set_key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("hashes").alias("hashes")), "near-nodes")
    linked = components(near_links(nodes.select("node", "hashes"), percent, **how))
    classes = nodes.select("set_key", "node", "copies").join(linked, "node", "left").where("component is not null or copies > 1")
    return own.select("id", "set_key").join(classes, "set_key").select(F.col("id").alias(id_col), F.coalesce("component", "node").alias("class_id"))
