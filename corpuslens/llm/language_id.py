"""Language identification by compression with one raw-content dictionary for each language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean_batches
from .vocab import tidied

LETTER = r"\p{L}"
#: Production parameters: texts sampled for a language, characters taken of each, compression level.
SAMPLE_TEXTS, SAMPLE_CHARS, LEVEL = 256, 1024, 6
#: A text whose best size is within this share of the next best is rejected.
MIN_MARGIN = 0.01
#: A longer text is compressed in blocks of at most so many bytes, each with the dictionary afresh.
BLOCK_BYTES = 4096


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def learn_dictionaries(labelled: DataFrame, *, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Raw content for each language of labelled(text, lang): passages of at most so many different texts.

    The sample is the texts of least hash, thinned by a threshold from each language's count before
    anything is ranked, so that no language's rows meet in one task. Only the passages, at most
    texts x chars for each language, come to the driver. Equal texts count once. Passages are
    lower-cased. Languages come in the order of how many texts they have.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).select("text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not counts:
        return {}
    whole = 1 << 30
    limits = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(whole, 4 * texts * whole // max(n, 1)))])
    draw = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(whole))
    thin = rows.withColumn("draw", draw).where(F.col("draw") < F.element_at(limits, F.col("lang")))
    begin = F.pmod(F.col("draw"), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    passages = thin.select("lang", "draw", F.substring("text", begin, F.lit(chars)).alias("passage")).dropDuplicates(["lang", "draw", "passage"])
    ranked = passages.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "passage"))).where(F.col("rank") <= texts)
    found: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "rank").collect():
        found.setdefault(r["lang"], []).append(r["passage"])
    return {lang: "\n".join(found[lang]).lower().encode() for lang in sorted(found, key=lambda x: (-counts[x], x))}


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes], *, level: int = LEVEL, min_margin: float = MIN_MARGIN, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score and rejected after its columns; lang, source and doc_id play no part.

    The whole text, lower-cased, is compressed with each dictionary in blocks of equal length; the
    smallest sum over all blocks names the language (ties, as of a few letters: the first in
    dictionaries). A dictionary saves a bounded number of bytes a block, so the margin doesn't shrink
    as texts get longer. score is the share by which the next best is larger, 0 to 1 (1 with
    a single language); rejected says that it is under min_margin. A null text, or one without a
    letter, is ``und`` with score 0 and rejected, as is every text if nothing was learned. Columns of
    docs that have these names already are replaced, unless a prefix sets the new ones apart. Rows stay where they are; an empty table gives
    an empty table.
    """
    lean_batches(docs.sparkSession)
    names = list(dictionaries)
    added = [prefix + x for x in ("lang_pred", "score", "rejected")]
    kept = [c for c in docs.columns if c not in added]
    held = docs.select(*kept)
    place = kept.index("text")
    letters = F.coalesce(F.col("text").rlike(LETTER), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [zstandard.ZstdCompressor(level=level, dict_data=prepared(dictionaries[x], level), write_checksum=False, write_content_size=False, write_dict_id=False) for x in names]
        for batch in batches:
            out = []
            for text, ok in zip(batch.column(place), batch.column(len(kept)).to_pylist(), strict=True):
                if not ok or not names:
                    out.append(("und", 0.0, True))
                    continue
                data = text.as_py().lower().encode()
                parts = blocks(data)
                sizes = [sum(len(c.compress(x)) for x in parts) for c in by]
                best, *more = sorted(sizes)
                score = 1 - best / more[0] if more else 1.0
                out.append((names[sizes.index(best)], score, score < min_margin))
            said = list(zip(*out, strict=True)) or [(), (), ()]
            columns = [*batch.columns[:-1], pa.array(said[0], pa.string()), pa.array(said[1], pa.float64()), pa.array(said[2], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *added])

    schema = held.select("*", *[F.lit(x).alias(c) for x, c in zip(("", 0.0, True), added, strict=True)]).schema
    return held.select("*", letters.alias(f"{prefix}has_letters")).mapInArrow(tidied(run), schema)


def blocks(data: bytes, size: int = BLOCK_BYTES) -> list[bytes]:
    """data in the fewest consecutive parts of at most so many bytes, as equal in length as can be."""
    n = max(1, -(-len(data) // size))
    return [data[len(data) * i // n : len(data) * (i + 1) // n] for i in range(n)]


def prepared(content: bytes, level: int) -> zstandard.ZstdCompressionDict:
    made = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=level)
    return made


def drop_unidentified(docs: DataFrame, **learning) -> DataFrame:
    """docs, all columns as they were, without the texts whose language is rejected.

    Learns from the rows that have a lang and aren't held out. A text of any length is judged whole;
    rows without an id, repeated rows and nulls are judged like any other.
    """
    dictionaries = learn_dictionaries(docs.where(~is_held_out(F.col("doc_id"))), **learning)
    prefix = "id_"
    while any(c.lower().startswith(prefix) for c in docs.columns):  # no column of docs is touched
        prefix += "_"
    return predict_language(docs, dictionaries, prefix=prefix).where(~F.col(f"{prefix}rejected")).select(*docs.columns)
