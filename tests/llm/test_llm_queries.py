"""The registered queries over the given small tables, and the pipeline stage by stage."""

import hashlib
import zlib
from collections import defaultdict

import brute
import duckdb
import oracle
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpuslens.llm import language_id, queries
from corpuslens.llm.shared import documents
from corpuslens.llm.vocab import read_ranks


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, con, name):
    assert oracle.differences(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], con) == ""


def test_components(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_ngram_jaccard(spark, sf_dir).collect()}
    assert got == brute.components(rows)


def test_language_of_held_out_rows(spark, sf_dir):
    said = queries.op7_language_id(spark, sf_dir)
    assert said.count() == documents(spark, sf_dir).count()
    held = said.where("held_out").join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.9


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in documents(spark, sf_dir).select("doc_id", "text").collect()}


def test_statistics_of_the_query(spark, sf_dir, texts):
    got = queries.op2_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.statistics(texts[r.doc_id]) and not (r.base_failed and r.kept)


def test_shards_of_the_query(spark, sf_dir, texts):
    got = queries.op3_hilbert_shards(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    slots = defaultdict(list)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_token_files_of_the_query(spark, sf_dir, texts):
    library, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in queries.op4_huffman_tokens(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), brute.crc(ids))
        start += len(ids)


def test_packing_of_the_query(spark, sf_dir, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in queries.op5_packing(spark, sf_dir).collect():
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts) and sorted(by_seq) == list(range(len(by_seq)))
    for i, own in by_doc.items():
        ids, at = [*library.encode(texts[i], add_special_tokens=False).ids, 0], 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), brute.crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_round_trip_of_the_query(spark, sf_dir, texts):
    library = tiktoken.Encoding("own4", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in queries.op8_prefix_bpe(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        ids = library.encode_ordinary(text)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_language_against_plain_compression(spark, sf_dir, texts):
    docs = documents(spark, sf_dir)
    learned = language_id.learn_dictionaries(docs.where(~language_id.is_held_out(F.col("doc_id"))))
    said = {r.doc_id: r for r in queries.op7_language_id(spark, sf_dir).collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in said.items() if r.held_out} == held and len(learned) > 1
    names = list(learned)
    by = [zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(learned[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False) for x in names]
    for i, text in texts.items():
        if not any(c.isalpha() for c in text):
            assert (said[i].lang_pred, said[i].score, said[i].rejected) == ("und", 0.0, True)
            continue
        data = text.lower().encode()
        n = max(1, -(-len(data) // language_id.BLOCK_BYTES))
        sizes = [sum(len(c.compress(data[len(data) * k // n : len(data) * (k + 1) // n])) for k in range(n)) for c in by]
        best, second = sorted(sizes)[:2]
        assert said[i].lang_pred == names[sizes.index(best)] and abs(said[i].score - (1 - best / second)) < 0.02


def test_pipeline_stage_by_stage(spark, sf_dir):
    """Each stage over what the one before it kept, against plain Python."""
    docs = documents(spark, sf_dir)
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {n: None for n in names}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        now = spark.createDataFrame(now.collect(), now.schema)
        kept[name] = now
        if name != names[-1]:
            assert now.columns == docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    after = lambda n: {r.doc_id: r.text for r in kept[n].collect()}
    first = after(names[0])
    learned = language_id.learn_dictionaries(docs.where(~language_id.is_held_out(F.col("doc_id"))))
    rejected = {r.doc_id for r in language_id.predict_language(docs, learned).where("rejected").collect()}
    assert set(first) == set(before) - rejected
    second = after(names[1])
    assert all(not brute.statistics(t)[5] for t in second.values())
    third = after(names[2])
    assert set(third) == {w[0] for w in brute.exact(list(second.items())).values()}
    fourth = after(names[3])
    assert set(fourth) == {i for i, (_, c) in brute.components(list(third.items())).items() if i == c}
    pieces = defaultdict(int)
    for r in kept[names[4]].collect():
        pieces[r.doc_id] += r.length
    assert set(pieces) == set(fourth)
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf_dir}/labels.parquet'").fetchall())
    good = [i for i, t in first.items() if labels.get(i) == 1 and not brute.statistics(t)[5]]
    assert sum(i in second for i in good) >= 0.97 * len(good)
