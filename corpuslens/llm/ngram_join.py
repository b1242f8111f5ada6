"""Exact Jaccard self-join of word shingle sets, down to connected components.

Set relations do the skipping. Equal sets are one node. Sets most of whose shingles occur nowhere
else leave before any candidate is made. Sets that a few rounds of comparing within small blocks
have already connected need no more links between them, so the inverted index is probed only across
components, block by block, with bounds on size and position; and a probe's overlaps with the sets of
a block follow from its overlap with the block's leader.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import BROADCAST_ROWS, broadcast_if_small, keep_one, lean_batches, row_key, written
from .shingles import BlockIndex, set_key, shingle_sets
from .vocab import give_back, text_batches, tidied

#: Tokens that a task of the first filter compares at a time, sets in a block, probes of a block in a task.
BUCKET_TOKENS, BLOCK, PROBES = 1_000_000, 64, 512
ROUNDS = 3
#: A list of more entries than this is probed by position blocks, whichever components they are of.
LONG_LIST = 1024


def _at_least(n, percent: int):
    """Least overlap of a set of n with any partner: ceil(percent n / 100)."""
    return (n * percent + 99) // 100


def _lead(n, percent: int):
    """How many common shingles are looked for among the first of both sets."""
    return (n * (100 - percent)) // 100 + 1


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key (row_key of the text), n_shingles, set_key (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_batches(whole, 2)):
            sets = shingle_sets(batch.column(2), words)
            keys = [set_key(x) if len(x) else None for x in sets]
            columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "set_key"])

    rows = docs.select(F.col("doc_id").cast("long"), row_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(tidied(run), "doc_id long, text_key binary, n_shingles long, set_key binary")


def shared_counts(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """set_id (first 8 bytes of set_key), shared: how many of the set's leading shingles other sets lead with too.

    Leading: the least hashes, so many that any two sets that link have at least _lead of them in
    common there. Shingles are dealt by hash as arrays. A batch settles what its own sets share and
    sends on each shingle once, so a shingle that a third of all texts hold is a row from each batch.
    A bucket's counts go on as one array for each of as many groups of sets, where they are summed.
    Equal sets may count twice, never less than once: it only filters.
    """
    schema = "bucket int, owner binary, runs binary, tokens binary"

    def by_set(ids: np.ndarray, met: np.ndarray) -> pa.Table:
        place = ids % np.uint64(buckets)
        order = np.argsort(place, kind="stable")
        first = np.flatnonzero(np.diff(place[order].astype(np.int64), prepend=-1))
        cuts = list(zip(first.tolist(), np.append(first, len(ids))[1:].tolist(), strict=True))
        parts = [(int(place[order[i]]), ids[order[i:j]].tobytes(), met[order[i:j]].astype("<i8").tobytes()) for i, j in cuts]
        return pa.table([pa.array([x[k] for x in parts], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["place", "ids", "met"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "owner", "runs", "tokens"]
        for batch in (part for whole in batches for part in text_batches(whole, 0)):
            by_key = {}
            for x in shingle_sets(batch.column(0), words):
                if len(x):
                    by_key.setdefault(int.from_bytes(set_key(x)[:8], "big"), x)
            if not by_key:
                continue
            ids = np.fromiter(by_key, np.uint64, len(by_key))
            lead = [x[: len(x) - _at_least(len(x), percent) + _lead(len(x), percent)] for x in by_key.values()]
            tokens, owner = np.concatenate(lead), np.repeat(np.arange(len(lead)), [len(x) for x in lead])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            first = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] - np.uint64(1)) != 0) if len(tokens) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(tokens)))
            met = np.bincount(owner[np.repeat(n > 1, n)], minlength=len(ids)).astype(np.int64)
            kept, here = tokens[first], np.where(n > 1, len(ids), owner[first])  # one past the last: shared here
            bucket = (kept % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((here, bucket))
            kept, here, bucket = kept[order], here[order], bucket[order]
            run = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(here, prepend=-1) != 0))
            size = np.diff(np.append(run, len(kept)))
            named = np.append(ids, np.uint64(0))[here[run]]  # 0 stands for "several"
            rows = [(-1, ids.tobytes(), met.tobytes(), b"")]
            edges = np.flatnonzero(np.diff(bucket[run], prepend=-1))
            for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(run)], strict=True):
                begin, end = run[i], run[j] if j < len(run) else len(kept)
                rows.append((int(bucket[run[i]]), named[i:j].tobytes(), size[i:j].astype(np.int64).tobytes(), kept[begin:end].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

    def meet(table: pa.Table) -> pa.Table:
        owner, runs = joined(table, "owner", np.uint64), joined(table, "runs", np.int64)
        if table.column("bucket")[0].as_py() < 0:  # already counted in their batches
            ids, met = owner, runs
        else:
            tokens, who = joined(table, "tokens", np.uint64), np.repeat(owner, runs)
            order = np.lexsort((who, tokens))
            tokens, who = tokens[order], who[order]
            new = np.diff(tokens, prepend=tokens[:1] - np.uint64(1)) != 0
            distinct = new | (np.diff(who, prepend=who[:1]) != 0)
            who, new = who[distinct], new[distinct]
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(who)))
            several = np.repeat((n > 1) | (who[first] == 0), n) & (who != 0)
            ids, met = np.unique(who[several], return_counts=True)
        out = by_set(ids, met)
        give_back()
        return out

    def total(table: pa.Table) -> pa.Table:
        ids, at = np.unique(joined(table, "ids", np.uint64), return_inverse=True)
        met = np.bincount(at, joined(table, "met", np.int64), len(ids)).astype(np.int64)
        return pa.table({"set_id": pa.array(ids.view(np.int64)), "shared": pa.array(met)})

    dealt = docs.select("text").mapInArrow(tidied(deal), schema)
    part = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("owner"), F.lit(buckets))).otherwise(F.col("bucket"))
    met = dealt.withColumn("part", part).groupBy("part").applyInArrow(meet, "place int, ids binary, met binary")
    return met.groupBy("place").applyInArrow(total, "set_id long, shared long")


def joined(table: pa.Table, column: str, kind: type) -> np.ndarray:
    """The arrays that a binary column's rows hold, one after the other."""
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def verify_blocks(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) between the members, or from probes to members, of each group of rows.

    rows: keys, node, n, tokens, probe (whether the row is compared with the members or is one). A
    group without probes compares its members with each other, and returns as few links as connect
    what it found.
    """

    def run(table: pa.Table) -> pa.Table:
        node, n = table.column("node").to_pylist(), table.column("n").to_numpy()
        flat = table.column("tokens").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        begin = flat.offsets.to_numpy()
        values = flat.values.to_numpy()
        sets = [np.sort(values[i:j]) for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        probe = table.column("probe").to_numpy(zero_copy_only=False)
        members = np.flatnonzero(~probe)
        probes = np.flatnonzero(probe) if probe.any() else members
        links: list[tuple[bytes, bytes]] = []
        if len(members) and (len(members) > 1 or probe.any()):
            index, size = BlockIndex([sets[i] for i in members]), n[members]
            root = list(range(len(node)))

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for p in probes.tolist():
                needed = -(-percent * (n[p] + size) // (100 + percent))
                found = index.overlaps(sets[p], needed)
                for k in members[(found >= needed) & (found > 0)].tolist():
                    if (a := top(p)) != (b := top(k)):
                        root[a] = b
                        links.append((node[p], node[k]))
        return pa.table({"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary())})

    return rows.select(*keys, "node", "n", "tokens", "probe").groupBy(*keys).applyInArrow(run, "a binary, b binary")


def ngram_components(docs: DataFrame, *, words: int = 5, percent: int = 75, rounds: int = ROUNDS, long_list: int = LONG_LIST, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each row of docs(doc_id, text): doc_id, n_shingles, component_id, text_key, stays.

    Two documents link when 100 x the size of their sets' intersection is at least percent x that of
    their union; component_id is the least doc_id reachable by links. Documents without words link
    with nothing. A null text has no words; rows that repeat a text link with each other; a document
    whose id is null takes the least id of its component, null if that has none. A text of any length
    is one set, hashed whole in its task. An empty table gives an empty table; other columns are
    ignored. stays holds for the row of least id, then text_key, of each component.
    """
    lean_batches(docs.sparkSession)
    sets = written(document_sets(docs, words), "sets")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = sets.where("set_key is not null").groupBy("set_key").agg(F.min(first).alias("least"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "nodes")
    tokens = nodes.agg(F.sum("n")).first()[0] or 0
    met = shared_counts(docs, words, percent, int(-(-tokens // BUCKET_TOKENS) or 1))
    set_id = F.conv(F.hex(F.substring("set_key", 1, 8)), 16, -10).cast("long")
    least_n = F.expr(f"(((n * {percent} + 99) div 100) * {100 - percent}) div 100 + 1")
    alive = nodes.withColumn("set_id", set_id).join(met, "set_id").where(F.col("shared") >= least_n).select("set_key", F.col("least.doc_id").alias("least"))
    alive = written(alive, "alive")
    ordered = written(ordered_sets(docs, alive, words, percent, broadcast_rows), "ordered")
    found = written(nearby_links(ordered, percent, rounds), "nearby")
    known = connected_components(found)
    more = written(crossing_links(ordered, known, percent, long_list), "crossing")
    if more.take(1):
        known = connected_components(found.unionByName(more))
    labelled = known.join(nodes.select(F.col("set_key").alias("node"), "least"), "node")
    label = written(labelled.groupBy("component").agg(F.min("least").alias("label")), "label")
    joined = known.join(label, "component").select(F.col("node").alias("set_key"), "label")
    several = nodes.join(joined, "set_key", "left").where("copies > 1 or label is not null").select("set_key", F.coalesce("label", "least").alias("label"))
    side = broadcast_if_small(written(several, "several"), broadcast_rows)
    alone = F.col("label").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("label.doc_id"))
    stays = alone | (F.col("doc_id").eqNullSafe(F.col("label.doc_id")) & (F.col("text_key") == F.col("label.text_key")))
    return sets.join(side, "set_key", "left").select("doc_id", "n_shingles", component.alias("component_id"), "text_key", stays.alias("stays"))


def ordered_sets(docs: DataFrame, alive: DataFrame, words: int, percent: int, broadcast_rows: int) -> DataFrame:
    """node (set_key), n, tokens: the shingles that other surviving sets hold too, rarest first.

    Sets too few of whose shingles are left to link with anything are gone.
    """
    ids = written(alive.select("least").distinct(), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_batches(whole, 0)):
            sets = [x for x in shingle_sets(batch.column(0), words) if len(x)]
            columns = [pa.array([set_key(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["set_key", "n", "tokens"])

    side = broadcast_if_small(ids, broadcast_rows)
    texts = docs.select("doc_id", "text").join(side, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi").select("text")
    whole = texts.mapInArrow(tidied(run), "set_key binary, n long, tokens array<long>").join(alive, "set_key", "left_semi").dropDuplicates(["set_key"])
    whole = written(whole.withColumnRenamed("set_key", "node"), "whole")
    postings = whole.select("node", "n", F.explode("tokens").alias("token"))
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = postings.join(counts, "token").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("held"))
    return lists.where(F.expr(f"size(held) >= (n * {percent} + 99) div 100")).select("node", "n", F.col("held.token").alias("tokens"))


def nearby_links(ordered: DataFrame, percent: int, rounds: int) -> DataFrame:
    """Links inside blocks of about 64 sets that have a least hash in common, in a few rounds."""
    def seeded(j: int):
        return lambda token: F.xxhash64(token, F.lit(j))

    keys = [F.struct(F.lit(j).alias("round"), F.array_min(F.transform("tokens", seeded(j))).alias("least")) for j in range(rounds)]
    keyed = ordered.select("node", F.explode(F.array(*keys)).alias("k")).select("node", "k.*")
    sizes = keyed.groupBy("round", "least").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    deal = F.pmod(F.xxhash64("node", "round"), F.ceil(F.col("size") / BLOCK))
    placed = keyed.join(written(sizes, "sizes"), ["round", "least"]).select("node", "round", "least", deal.alias("deal"))
    rows = placed.join(ordered, "node").withColumn("probe", F.lit(False))
    return verify_blocks(rows, ["round", "least", "deal"], percent)


def crossing_links(ordered: DataFrame, known: DataFrame, percent: int, long_list: int = LONG_LIST) -> DataFrame:
    """All links that connect two components of known, or as many as connect the same.

    The prefix of a set: its rarest shingles, so many that no partner can miss them all. Under a
    shingle of both prefixes a set probes sets of other components, the smaller component the larger;
    lists longer than long_list are probed by position blocks (``long_list_links``).
    """
    comp = ordered.select("node").join(known, "node", "left").select("node", F.coalesce("component", "node").alias("comp"))
    comp = written(comp, "comp")
    sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("comp_size"))
    deal = F.when(F.col("comp_size") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("comp_size") / BLOCK)))
    placed = written(comp.join(written(sizes, "comp_sizes"), "comp").select("node", "comp", "comp_size", deal.cast("long").alias("block")), "placed")
    prefix = F.expr(f"slice(tokens, 1, cast(size(tokens) - (n * {percent} + 99) div 100 + 1 as int))")
    postings = ordered.select("node", "n", F.size("tokens").alias("m"), F.posexplode(prefix).alias("pos", "token")).join(placed, "node")
    postings = written(postings.select("token", "node", "n", (F.col("m") - F.col("pos")).alias("left"), "comp", "comp_size", "block"), "postings")
    mixed = postings.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("entries")).where("a != b").select("token", "entries")
    lists = written(postings.join(written(mixed, "mixed"), "token"), "lists")
    long, short = lists.where(F.col("entries") > long_list), lists.where(F.col("entries") <= long_list)
    blocks = short.groupBy("token", "comp", "comp_size", "block").agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.max("left").alias("room"))
    blocks = blocks.select("token", *[F.col(c).alias(f"b_{c}") for c in ("comp", "comp_size", "block", "min_n", "max_n", "room")])
    order: Column = F.struct("comp_size", "comp") < F.struct(F.col("b_comp_size").alias("comp_size"), F.col("b_comp").alias("comp"))
    probes = short.join(written(blocks, "blocks"), "token").where(order & may_reach(percent)).select("node", "b_comp", "b_block").distinct()
    members = placed.select("node", F.col("comp").alias("b_comp"), F.col("block").alias("b_block"))
    links = probed(written(probes, "probes"), members, ordered, ["b_comp", "b_block"], percent)
    return links.unionByName(long_list_links(long, ordered, percent)) if long.take(1) else links


def may_reach(percent: int) -> Column:
    """Whether an entry (n, left) may link with any of a block (b_min_n, b_max_n, b_room): sizes first, then positions."""
    sized = (100 * F.col("b_max_n") >= percent * F.col("n")) & (percent * F.col("b_min_n") <= 100 * F.col("n"))
    reach = (100 + percent) * F.least("left", "b_room") >= percent * (F.col("n") + F.greatest(F.col("b_min_n"), F.expr(f"(n * {percent} + 99) div 100")))
    return sized & reach


def probed(probes: DataFrame, members: DataFrame, ordered: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links from probes(node, keys) to the members(node, keys) of their blocks; a block's probes are split evenly."""
    asked = written(probes.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PROBES).alias("salts")), "asked")
    salt = F.pmod(F.xxhash64("node", F.lit(3)), F.col("salts"))
    asking = probes.join(asked, keys).select("node", *keys, salt.alias("salt"), F.lit(True).alias("probe"))
    answering = members.join(asked, keys).select("node", *keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("probe"))
    return verify_blocks(asking.unionByName(answering).join(ordered, "node"), [*keys, "salt"], percent)


def long_list_links(lists: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """Links under shingles that very many sets lead with.

    A list is range partitioned: large components first, each by itself, then the others by size of
    set. It is cut into blocks of BLOCK positions, and an entry probes the blocks up to its own whose
    bounds it may reach, other than those of its own component: rows grow with entries x blocks, not
    with pairs of entries. Entries meet only blocks of a class of sizes next to their own: a set links
    with sets of its class, the one below and the one above.
    """
    ratio = math.log(100 / percent) if percent < 100 else 1.0
    size_class = lambda c: F.floor(F.ln(c) / (1.0001 * ratio)).cast("int")
    large = F.when(F.col("comp_size") > BLOCK, F.col("comp_size")).otherwise(0)
    order = [F.col("token"), large.desc(), F.when(large > 0, F.col("comp")), F.col("n"), F.col("node")]
    ranged = lists.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = written(ranged.select("token", "node", "n", "left", "comp", F.expr(f"at div {BLOCK}").alias("position")), "long-lists")
    bounds = ranged.groupBy("token", F.col("position").alias("b_position")).agg(
        *[f(c).alias(f"b_{k}") for k, f, c in (("min_n", F.min, "n"), ("max_n", F.max, "n"), ("room", F.max, "left"), ("least", F.min, "comp"), ("most", F.max, "comp"))]
    )
    other = (F.col("b_least") != F.col("comp")) | (F.col("b_most") != F.col("comp"))
    classes = F.explode(F.sequence(size_class("b_min_n") - 1, size_class("b_max_n") + 1)).alias("class")
    bounds = written(bounds.select("*", classes), "bounds")
    probes = ranged.withColumn("class", size_class("n")).join(bounds, ["token", "class"]).where((F.col("position") >= F.col("b_position")) & other & may_reach(percent))
    probes = written(probes.select("node", "token", "b_position"), "long-probes")
    members = ranged.select("node", "token", F.col("position").alias("b_position"))
    return probed(probes, members, ordered, ["token", "b_position"], percent)


def drop_near_duplicates(docs: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS, **how) -> DataFrame:
    """docs, all columns as they were, with one row of each component: that of least id, then text.

    Rows with and without an id count alike, and rows that share an id but not a text are told apart.
    Of rows that repeat both, one stays.
    """
    rows = ngram_components(docs, broadcast_rows=broadcast_rows, **how)
    counts = rows.groupBy(F.col("doc_id").alias("drop_id"), F.col("text_key").alias("drop_key")).agg(F.count_if("stays").alias("kept"), F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("words"))
    return keep_one(docs, written(counts.where("kept = 0 or n > 1 and words > 0").drop("words"), "near"), broadcast_rows)
