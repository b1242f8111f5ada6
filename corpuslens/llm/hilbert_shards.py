"""Sharding along a Hilbert curve over quantised metadata, in files that readers can skip."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, broadcast_if_small, let, text_or_empty, written

#: Dimensions of the production layout.
DIMENSIONS = ("lang", "source", "bytes")


def ordered_key(value: Column) -> Column:
    """A string that sorts as value does, byte by byte and over its whole length; null before all others."""
    return F.coalesce(F.concat(F.lit("v"), value.cast("string")), F.lit(""))


def string_cuts(rows: DataFrame, key: str, points: list[float]) -> list[str]:
    """The values of key at which so many shares of the rows are reached, each once, in order.

    Rows are counted for each distinct value, the values range partitioned, and the counts summed
    from partition to partition. Only the cut points and a row a partition come to the driver.
    """
    counts = written(rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")), "values")
    ranged = counts.repartitionByRange("key").sortWithinPartitions("key").withColumn("at", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("part", F.shiftright("at", 33)), "values-ranged")
    starts, total = [], 0
    for p, n in sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("n")).collect()):
        starts.append((p, total))
        total += n
    if not total:
        return []
    running = F.sum("n").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    offsets = rows.sparkSession.createDataFrame(starts, "part long, start long")
    reached = ranged.withColumn("running", running).join(F.broadcast(offsets), "part").withColumn("reached", F.col("start") + F.col("running"))
    found = reached.agg(*[F.min(F.when(F.col("reached") >= math.ceil(p * total), F.col("key"))).alias(f"c{i}") for i, p in enumerate(points)]).first()
    return sorted(set(found), key=str.encode)


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a cell whose coordinates have so many bits each.

    Skilling's transpose form, as folds over literal step lists, so the expression's size is
    bits x dimensions and nothing is evaluated twice.
    """
    dims = len(coords)
    q_desc = [1 << b for b in range(bits - 1, -1, -1)]

    def steps(qs: list[int]) -> Column:
        return F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q in qs for i in range(dims)])

    def unrotate(x: Column, s: Column) -> Column:
        p, xi = s["q"] - 1, F.get(x, s["i"])
        swap = (F.get(x, F.lit(0)).bitwiseXOR(xi)).bitwiseAND(p)
        on = xi.bitwiseAND(s["q"]) != 0
        return F.transform(x, lambda v, j: F.when(on & (j == 0), v.bitwiseXOR(p)).when(~on & ((j == 0) | (j == s["i"])) & (s["i"] != 0), v.bitwiseXOR(swap)).otherwise(v))

    def gray(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda k: F.aggregate(F.slice(x, 1, k), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v)))

    def settle(x: Column) -> Column:
        qs = F.array(*[F.lit(q).cast("long") for q in q_desc if q > 1] or [F.lit(0).cast("long")])
        t = F.aggregate(qs, F.lit(0).cast("long"), lambda a, q: F.when(F.get(x, F.lit(dims - 1)).bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
        return let(t, lambda u: F.transform(x, lambda v: v.bitwiseXOR(u)))

    def interleave(x: Column) -> Column:
        return F.aggregate(steps(q_desc), F.lit(0).cast("long"), lambda a, s: a * 2 + F.when(F.get(x, s["i"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0))

    start = F.array(*[c.cast("long") for c in coords])
    turned = F.aggregate(steps([q for q in q_desc if q > 1]), start, unrotate) if bits > 1 else start
    return let(turned, lambda x: let(gray(x), lambda g: let(settle(g), interleave)))


@dataclass(frozen=True)
class Layout:
    """Where rows go: the cells' cut points, the key at which each shard begins, and repeated rows at such a cut.

    key: (curve, tie, doc_id). tied: keys of rows that repeat id and text on both sides of a cut, with
    the rank of the first; such rows are numbered one by one.
    """

    shards: int
    bits: int
    total: int
    cuts: dict[str, list]
    begins: list[Row]
    tied: list[tuple[Row, int]]


def _size() -> Column:
    return (F.octet_length(text_or_empty()) + 1).cast("long")


def _curve(layout_cuts: dict[str, list], bits: int) -> Column:
    values = {"lang": ordered_key(F.col("lang")), "source": ordered_key(F.col("source")), "bytes": _size()}
    cell = lambda d: let(values[d], lambda v: reduce(lambda a, c: a + (v >= F.lit(c)).cast("int"), layout_cuts[d], F.lit(0)))
    return hilbert_index([cell(d) for d in DIMENSIONS], bits)


def _key(row: Row) -> Column:
    return F.struct(F.lit(row["curve"]).cast("long").alias("curve"), F.lit(row["tie"]).cast("long").alias("tie"), F.lit(row["doc_id"]).cast("long").alias("doc_id"))


def _copies(rows: DataFrame) -> DataFrame:
    """__copied (a text hash of several rows), __least: the least position that any of the copies has."""
    counts = rows.groupBy(F.col("tie").alias("__copied")).agg(F.count(F.lit(1)).alias("n"), F.min("curve").alias("__least"))
    return written(counts.where("n > 1").drop("n"), "copies")


def _together(rows: DataFrame, copies: DataFrame, broadcast_rows: int) -> DataFrame:
    """rows with the curve position that all copies of a text share."""
    joined = rows.join(broadcast_if_small(copies, broadcast_rows), F.col("tie") == F.col("__copied"), "left")
    return joined.withColumn("curve", F.coalesce("__least", "curve")).drop("__copied", "__least")


def plan_shards(docs: DataFrame, *, shards: int = 16, bits: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> tuple[Layout, DataFrame]:
    """The layout of docs(doc_id, text, lang, source), and the curve positions of repeated texts.

    Each dimension is cut at quantiles of all rows, so that a hot source takes cells of its own and
    the others keep theirs. Ranks come from a range partitioning of narrow rows by (curve, text hash,
    id), in which no group is larger than a row, and the sizes of its partitions. To the driver come
    the cut points (3 x 31), a row a partition, and a key a shard.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")
    )
    keys = ordered_key(F.col("lang")).alias("lang_key"), ordered_key(F.col("source")).alias("source_key")
    narrow = rows.select("doc_id", _size().alias("size"), F.xxhash64(text_or_empty()).alias("tie"), *keys)
    narrow = written(narrow, "rows")
    points = [k / 2**bits for k in range(1, 2**bits)]
    found = narrow.agg(F.percentile_approx("size", points, 10_000)).first()[0]
    cuts = {"lang": string_cuts(narrow, "lang_key", points), "source": string_cuts(narrow, "source_key", points), "bytes": sorted(set(found or []))}
    values = {"lang": F.col("lang_key"), "source": F.col("source_key"), "bytes": F.col("size")}
    cell = lambda d: reduce(lambda a, c: a + (values[d] >= F.lit(c)).cast("int"), cuts[d], F.lit(0))
    placed = narrow.select("doc_id", "tie", hilbert_index([cell(d) for d in DIMENSIONS], bits).alias("curve"))
    copies = _copies(placed)
    order = ["curve", "tie", "doc_id"]
    ranged = _together(placed, copies, broadcast_rows).select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    sizes = sorted(tuple(r) for r in ranged.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
    total = sum(n for _, n in sizes)
    place, before = {}, 0  # rank -> at, for the first row of each shard
    first = sorted({-(-k * total // shards) for k in range(1, shards)} - {total})
    for part, n in sizes:
        place |= {r: (part << 33) + r - before for r in first if before <= r < before + n}
        before += n
    found = {r["at"]: r for r in ranged.where(F.col("at").isin(list(place.values()))).collect()} if place else {}
    begins = [found[place[r]] for r in first]
    tied = []
    if begins:
        keys = reduce(lambda a, b: a | b, [F.struct(*order).eqNullSafe(_key(x)) for x in begins])
        starts, before = {}, 0
        for part, n in sizes:
            starts[part], before = before, before + n
        for r in ranged.where(keys).groupBy(*order).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).where("n > 1").collect():
            tied.append((r, starts[r["at"] >> 33] + (r["at"] & ((1 << 33) - 1))))
    return Layout(shards, bits, total, cuts, begins, tied), copies


def place_rows(docs: DataFrame, layout: Layout, copies: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with curve, tie, size and shard; columns of docs with these names are replaced."""
    rows = docs.drop("curve", "tie", "size", "shard").withColumns({"curve": _curve(layout.cuts, layout.bits), "tie": F.xxhash64(text_or_empty()), "size": _size()})
    rows = _together(rows, copies, broadcast_rows)
    key = F.struct("curve", "tie", F.col("doc_id").cast("long").alias("doc_id"))
    # shards that begin at the same place are empty but for the last of them
    ranks = sorted({-(-k * layout.total // layout.shards) for k in range(1, layout.shards)} - {layout.total})
    number = {r: r * layout.shards // max(layout.total, 1) for r in ranks}
    shard = F.coalesce(*[F.when(key >= _key(x), F.lit(number[r])) for r, x in reversed(list(zip(ranks, layout.begins, strict=True)))], F.lit(0))
    if not layout.tied:
        return rows.withColumn("shard", shard)
    is_tied = reduce(lambda a, b: a | b, [key.eqNullSafe(_key(x)) for x, _ in layout.tied])
    begin = F.coalesce(*[F.when(key.eqNullSafe(_key(x)), F.lit(rank).cast("long")) for x, rank in layout.tied])
    nth = F.row_number().over(Window.partitionBy("curve", "tie", "doc_id").orderBy("size")) - 1
    own = rows.where(is_tied).withColumn("shard", F.floor((begin + nth) * layout.shards / layout.total).cast("int"))
    return rows.where(~is_tied).withColumn("shard", shard).unionByName(own)


def write_shards(docs: DataFrame, path: str, *, shards: int = 16, bits: int = 5, run_rows: int = 100_000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Writes docs(doc_id, text, lang, source, ...) under path/data/shard=k in curve order; returns the manifest of its files.

    Row counts of shards differ by one at most. A file is a run: a stretch of at most run_rows rows
    of the curve. The manifest, at path/manifest, has a row for each: file, shard, start (the slot of
    its first row), rows, the least and greatest lang, source and size, and how many rows have no lang or
    source (null_lang, null_source), which a reader compares with its filter to skip the file. A row's slot is its file's start and its number in the file.

    Null texts have no bytes; null lang or source comes first in its dimension. Equal texts lie next to
    each other, at the least position that any of them has, whatever their metadata; ids break ties.
    Repeated rows are each written once; so are rows without an id. A text of any length is one row.
    An empty table gives an empty manifest. Other columns stay as they are, but for curve, tie, size,
    shard and (when read) slot, which are replaced.

    Texts are shuffled once: the keys at which shards begin are known before.
    """
    spark = docs.sparkSession
    layout, copies = plan_shards(docs, shards=shards, bits=bits, broadcast_rows=broadcast_rows)
    order = ["shard", "curve", "tie", "doc_id"]
    rows = place_rows(docs, layout, copies, broadcast_rows=broadcast_rows).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.option("maxRecordsPerFile", run_rows).partitionBy("shard").parquet(f"{path}/data")
    rows.limit(0).write.parquet(f"{path}/schema")
    read = spark.read.schema(rows.schema).parquet(f"{path}/data")
    bounds = [f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size") for n, f in (("min", F.min), ("max", F.max))]
    bounds += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("lang", "source")]
    begin = F.min(F.struct("curve", "tie", "doc_id")).alias("first")
    files = read.withColumn("__file", _file()).groupBy("shard", F.col("__file").alias("file")).agg(F.count(F.lit(1)).alias("rows"), begin, *bounds)
    before = Window.partitionBy("shard").orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("first").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def _file() -> Column:
    """The part of a file's path below data/, the same through any route to the folder."""
    return F.regexp_extract("_metadata.file_path", r"(shard=[^/]+/[^/]+)$", 1)


def read_shards(spark: SparkSession, path: str, predicate: str | None = None, where: str | None = None, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of the files whose bounds meet predicate (over min_, max_ and null_ columns of the manifest), with shard and slot.

    Other files are not opened. where is the condition on the rows themselves, which a file that is
    read needn't meet as a whole. The names of the files that match come to the driver.
    """
    manifest, schema = spark.read.parquet(f"{path}/manifest"), spark.read.parquet(f"{path}/schema").schema
    some = [f"{path}/data"]
    if predicate is not None:
        some = [f"{path}/data/{r['file']}" for r in manifest.where(predicate).select("file").collect()]
    if not some:
        return spark.read.parquet(f"{path}/schema").withColumn("slot", F.lit(0).cast("long"))
    read = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*some)
    starts = broadcast_if_small(manifest.select(F.col("file").alias("__file"), F.col("start").alias("__start")), broadcast_rows)
    rows = read.withColumns({"__file": _file(), "slot": F.col("_metadata.row_index")}).join(starts, "__file")
    rows = rows.withColumn("slot", F.col("__start") + F.col("slot")).drop("__file", "__start")
    return rows if where is None else rows.where(where)
