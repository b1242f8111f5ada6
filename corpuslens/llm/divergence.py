"""Source divergence audit: how far the sources of a language differ in their use of its terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, lean_batches, text_or_empty, written
from .vocab import tidied

#: A byte's own value if it belongs to a term (letters, and all bytes of characters from 80 on), with A-Z lowered; else a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at a time, so that a long text's words aren't all objects at once.
SLICE = 4 << 20
#: Terms of groups that a task adds up before it hands them on.
HELD_TERMS = 200_000
#: Uses of terms in a block, and cells of a matrix of terms and sources, when pairs are summed.
BLOCK_USES, CELLS = 200_000, 1 << 18


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a whole text in UTF-8."""
    found: Counter = Counter()
    lowered = text.translate(TERM_BYTES)
    start = 0
    while start < len(lowered):
        end = start + SLICE
        if end < len(lowered):  # a slice ends at a blank: the last one in it, or else the next one
            end = lowered.rfind(b" ", start, end) + 1 or lowered.find(b" ", end) + 1 or len(lowered)
        found.update(lowered[start:end].split())
        start = end
    return found


def count_terms(docs: DataFrame, held: int = HELD_TERMS) -> DataFrame:
    """lang, source, term (UTF-8), docs (that hold it) and n (occurrences), added up in each task; several rows may say of one term."""

    def rows(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (in_docs, times) in groups.items():
            terms = pa.array(in_docs.keys(), pa.binary())
            names = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), np.int32))) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, terms, pa.array(in_docs.values(), pa.int64()), pa.array([times[t] for t in in_docs], pa.int64())], ["lang", "source", "term", "docs", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, dict]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                in_docs, times = groups.setdefault((lang, source), (Counter(), {}))
                size -= len(in_docs)
                own = term_counts(text)
                in_docs.update(own.keys())
                for term, n in own.items():
                    times[term] = times.get(term, 0) + n
                size += len(in_docs)
                if size > held:
                    yield from rows(groups)
                    groups, size = {}, 0
        yield from rows(groups)

    names = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*names, text_or_empty().cast("binary").alias("text")).mapInArrow(tidied(run), "lang string, source string, term binary, docs long, n long")


def share(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * (n + 1) / size), exact without products over 64 bits for sizes up to 9e15."""
    whole, rest = np.zeros_like(n), n + 1
    for _ in range(3):
        whole, rest = 1000 * whole + 1000 * rest // size, 1000 * rest % size
    return whole + 1


def share_of(n: Column, size: Column) -> Column:
    """The same as a column."""
    return F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), size.cast("decimal(20,0)")) + 1


def far(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def pair_sums(vectors: pa.Table, groups: pa.Table) -> pa.Table:
    """lang, source, item, value: of a block of vectors of uses, for each two sources of the language."""
    names = groups.column("source").combine_chunks()
    of_times = vectors.column("times").to_numpy()
    own, v = groups.column("own").to_numpy(), groups.column("n_terms").to_numpy()
    size, count = own + v, len(names)
    sums = np.zeros((count, count), np.int64)
    if vectors.num_rows:
        unused = share(np.zeros(count, np.int64), size)
        uses = vectors.column("uses").combine_chunks()
        flat = uses.flatten()
        column = pc.index_in(flat.field("source"), value_set=names).to_numpy()
        row = np.repeat(np.arange(len(uses)), pc.list_value_length(uses).to_numpy())
        p = share(flat.field("n").to_numpy(), size[column])
        step = max(CELLS // count, 1)
        for first in range(0, len(uses), step):
            lo, hi = np.searchsorted(row, [first, first + step])
            cells = np.tile(unused, (min(step, len(uses) - first), 1))
            cells[row[lo:hi] - first, column[lo:hi]] = p[lo:hi]
            for s in range(count):
                gap = cells[:, s : s + 1] - cells
                sums[s] += of_times[first : first + step] @ (gap * gap // cells)
    at = np.arange(count)
    every = lambda i: names.take(pa.array(i))
    lang = groups.column("lang").combine_chunks().take(pa.array(np.zeros(count * count, np.int64)))
    return pa.table([lang, every(np.repeat(at, count)), every(np.tile(at, count)), pa.array(sums.ravel())], ["lang", "source", "item", "value"])


def source_divergence(docs: DataFrame, *, least_docs: int = 3, top_terms: int = 200, block_uses: int = BLOCK_USES) -> DataFrame:
    """One row for each (lang, source, part, item): value long and rank int, as the contract of op11 says.

    Terms are runs of letters and of characters from U+0080 on, with only A-Z lowered. A language keeps
    the terms in at least least_docs of its documents. Part ``pair`` compares a source with each other
    source of its language over all kept terms, part ``term`` gives the top_terms terms which the source
    uses more than its language does. All arithmetic is in integers.

    Tasks add up per-document counts of a bounded number of terms before they shuffle them, so a common
    term or a hot source is a row a task. Terms whose uses agree (the same counts in the same sources)
    are one vector with a multiplicity, and blocks of vectors are summed for all pairs of sources at
    once; no pair of sources is made for a term. Pairs are as many as the result has.

    Null text, lang and source are ''. A text without terms counts for its group only; a group without
    kept terms has pair rows, and a language's only source has none; values are 0 if the language keeps no
    term. Rows that repeat (an id or all columns) each count as a document. Ties in value are ranked by
    the item's bytes. A text of any length is split in slices, of which only the distinct terms stay. An
    empty table gives an empty table; doc_id and other columns aren't read.
    """
    lean_batches(docs.sparkSession)
    counts = count_terms(docs).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    uses = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("uses")  # of a source, one at most
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), uses).where(F.col("docs") >= least_docs)
    terms = written(terms.drop("docs"), "terms")
    used = terms.select("lang", "term", "total", F.inline("uses"))
    own = used.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    whole = terms.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("total").alias("of_lang"))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["own", "n_terms", "of_lang"])
    groups = written(groups, "groups")

    vectors = written(terms.groupBy("lang", "uses").agg(F.count("*").alias("times")), "vectors")
    blocks = -(-(vectors.agg(F.sum(F.size("uses"))).first()[0] or 0) // block_uses) or 1
    left = vectors.withColumn("block", F.pmod(F.xxhash64("uses"), F.lit(blocks)).cast("int"))
    right = groups.select("lang", "source", "own", "n_terms", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sums = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(pair_sums, "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    small = broadcast_if_small(groups)
    pairs = groups.select("lang", "source").join(small.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").fillna(0, ["value"])
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    p = share_of(F.col("n"), F.col("own") + F.col("n_terms"))
    q = share_of(F.col("total"), F.col("of_lang") + F.col("n_terms"))
    more = used.join(small, ["lang", "source"]).select("lang", "source", F.col("term").cast("string").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    more = more.select("lang", "source", "item", far(F.col("p"), F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top_terms)
    parts = [t.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, t in (("pair", pairs), ("term", more))]
    return parts[0].unionByName(parts[1])
