"""The operators over a small hostile table: nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations
from pathlib import Path

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslens.llm import chat_format, exact_dedup, hilbert_shards, language_id, ngram_join, packing, prefix_bpe, quality_rules, queries, token_files, url_filter
from corpuslens.llm.vocab import read_ranks

BPE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, h string, kept boolean, n long, tokens string"


def fixture_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "one two three four"), (5, " "), (6, "\n\t"), (7, "x" * 4000), (8, " ".join(base * 12))]
    for k in range(25):  # near copies, some of which only reach each other through others
        own = list(base)
        for _ in range(rng.randrange(1, 14)):
            own[rng.randrange(300)] = f"e{rng.randrange(5000)}"
        rows.append((20 + k, " ".join(own)))
    shared = " ".join(rng.choice(words) for _ in range(60))
    for k in range(15):  # one passage in texts that differ otherwise
        rows.append((60 + k, " ".join(rng.choice(words) for _ in range(90)) + " " + shared))
    rows += [(100, "same text here"), (101, "same text here"), (102, "same text here"), (102, "same text here"), (103, "Same text here")]
    rows += [(200 + k, "# $ % & * | < >\n" + "\n".join(["a line again"] * 30)) for k in range(3)]
    return [(i, t, "en" if i % 3 else None, "src0" if i % 4 else None, "h", True, 7, "t") for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return fixture_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def unique(rows):
    return sorted({(r[0], r[1]) for r in rows})


def test_exact_duplicates(docs, rows, empty):
    for limit in (1000, 0):
        got = exact_dedup.exact_duplicates(docs, broadcast_rows=limit).collect()
        assert len(got) == len(rows)
        want = brute.exact([r[:2] for r in rows])
        for r in got:
            assert (r.keep_id, r.group_size, r.text_sha256) == (want[r.doc_id][0], want[r.doc_id][1], want[r.doc_id][3])
        assert sorted(r.doc_id for r in got if r.kept) == sorted({w[0] for w in want.values()})
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_duplicates_tell_collisions_apart(docs, rows):
    weak = lambda text: F.substring(F.sha2(F.length(text).cast("string"), 256), 1, 4)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs, content_hash=weak).collect()}
    assert got == {i: x[:2] for i, x in brute.exact([r[:2] for r in rows]).items()}


def test_drop_exact_duplicates(docs, rows, empty):
    for limit in (1000, 0):
        left = exact_dedup.drop_exact_duplicates(docs, broadcast_rows=limit)
        assert left.columns == docs.columns
        got = left.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
        assert len(got) == len({r[1] or "" for r in rows}) == len({r.t for r in got})
        assert {r.doc_id for r in got} == {w[0] for w in brute.exact([r[:2] for r in rows]).values()}
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_ngram_components(docs, rows, empty):
    want = brute.components(unique(rows))
    for limit in (1000, 0):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, broadcast_rows=limit).collect()}
        assert got == want
    assert len({c for _, c in want.values()}) < len(want)
    assert ngram_join.ngram_components(empty).count() == 0
    left = ngram_join.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.select("doc_id").collect()} == {i for i, (_, c) in want.items() if i == c}


def test_ngram_components_without_the_first_rounds(docs, rows):
    want = {i: c for i, (_, c) in brute.components(unique(rows)).items()}
    for long_list in (1024, 1):  # every list goes by position blocks in the second
        got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs, rounds=1, long_list=long_list).collect()}
        assert got == want


def test_links_under_shingles_that_very_many_texts_share(spark):
    """Texts made of common sentences only: every shingle is frequent, and lists are far longer than a block."""
    rng = random.Random(5)
    said = [" ".join(f"s{k}w{j}" for j in range(12)) for k in range(24)]
    rows = [(i, " ".join(rng.sample(said, rng.randrange(5, 8)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, rounds=1, long_list=50).collect()}
    assert got == brute.components(rows)


def test_one_passage_in_very_many_short_texts(spark):
    passage = " ".join(f"p{j}" for j in range(80))
    rows = [(i, f"{passage} a{i} b{i} c{i}") for i in range(20_000)] + [(20_000 + i, f"x{i} y{i} z{i} {passage} " + " ".join(f"q{i}r{j}" for j in range(60))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(df).collect()}
    assert set(got[i] for i in range(20_000)) == {0} and all(got[20_000 + i] == 20_000 + i for i in range(50))


def test_near_duplicates_by_row(spark):
    """Rows without an id, with one id and two texts, and repeated rows."""
    base = " ".join(f"w{j}" for j in range(200))
    other = " ".join(f"v{j}" for j in range(200))
    rows = [(None, base), (5, base + " x"), (5, other), (9, other + " y"), (9, other + " y"), (3, base + " z"), (None, "alone and short"), (None, None), (None, None), (7, ""), (7, "")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, kept int, drop_id string")
    for limit in (1000, 0):
        left = ngram_join.drop_near_duplicates(df, broadcast_rows=limit)
        assert left.columns == df.columns
        assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == sorted([(3, base + " z"), (5, other), (-1, "alone and short"), (-1, ""), (-1, ""), (7, ""), (7, "")])


def test_quality(docs, rows, empty):
    got = quality_rules.quality_verdicts(docs, min_group=10).collect()
    assert len(got) == len(rows)
    texts = dict(unique(rows))
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.statistics(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert all(r.kept for r in got if 60 <= r.doc_id < 75)
    assert quality_rules.quality_verdicts(empty).count() == 0
    assert {r.doc_id for r in quality_rules.drop_low_quality(docs, min_group=10).collect()} == {r.doc_id for r in got if r.kept}


def plain_mcd(x, share=0.75):
    """Every start and step of the operator in numpy, with the same fixed diagonal."""
    d, floors = x.shape[1], np.array([f for _, f in quality_rules.FEATURES.values()])
    scale, h = quality_rules.consistency(d, share), int(np.ceil(share * len(x)))

    def fit(rows, by=1.0):
        return rows.mean(0), np.cov(rows.T, bias=True).reshape(d, d) * by + np.diag(floors**2)

    def step(state):
        off = x - state[0]
        d2 = np.einsum("ij,jk,ik->i", off, np.linalg.inv(state[1]), off)
        return fit(x[d2 <= np.sort(d2)[h - 1]], scale)

    middle = np.sort(x, 0)[(len(x) - 1) // 2]
    width = np.maximum(np.sort(np.abs(x - middle), 0)[(len(x) - 1) // 2] * 1.4826, floors)
    inner = x[(np.abs(x - middle) <= 2 * width).all(1)]
    starts = [(middle, np.diag(width**2)), fit(x), *([fit(inner)] if len(inner) else [])]
    best = min((step(step(s)) for s in starts), key=lambda s: np.linalg.det(s[1]))
    while np.linalg.det((new := step(best))[1]) < np.linalg.det(best[1]) * (1 - 1e-6):
        best = new
    return best


def test_robust_estimates_against_numpy(spark):
    rng = np.random.default_rng(4)
    good = rng.normal([5, 2, 0.1, 0.2, 0.2], [1, 0.3, 0.2, 0.4, 0.3], (400, 5))
    bad = rng.normal(30, 1, (60, 5))
    flat = np.tile([3.0, 1, 0, 0, 0], (50, 1))  # no spread at all
    df = spark.createDataFrame([(g, [float(v) for v in x]) for g, rows in (("g", np.vstack([good, bad])), ("flat", flat)) for x in rows], "grp string, x array<double>")
    found = {r["grp"]: r for r in quality_rules.robust_estimates(df, "grp").collect()}
    for g, rows in (("g", np.vstack([good, bad])), ("flat", flat)):
        mean, cov = plain_mcd(rows)
        assert np.allclose(found[g]["mean"], mean, rtol=1e-6) and np.allclose(np.array(found[g]["inverse"]).reshape(5, 5), np.linalg.inv(cov), rtol=1e-6)
        assert np.isclose(found[g]["determinant"], np.linalg.det(cov), rtol=1e-6)
    r = found["g"]
    inverse = np.array(r["inverse"]).reshape(5, 5)
    assert np.abs(np.array(r["mean"]) - good.mean(0)).max() < 0.2
    far = np.einsum("ij,jk,ik->i", bad - r["mean"], inverse, bad - r["mean"])
    near = np.einsum("ij,jk,ik->i", good - r["mean"], inverse, good - r["mean"])
    assert far.min() > 100 and np.quantile(near, 0.99) < quality_rules.chi2_quantile(5, 1 - 1e-5)


def test_kept_against_numpy(spark, sf_dir):
    """Verdicts of the query over a whole table, from its own statistics (held against brute force elsewhere)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = quality_rules.quality_verdicts(docs).collect()
    passed = [r for r in got if not r.base_failed]
    vector = lambda r: [np.log(max(r.n_words, 1)), np.log(max(r.word_chars, 1) / max(r.n_words, 1)), np.log1p(r.n_symbols / max(r.n_words, 1)), np.log1p(r.n_dup_lines / max(r.n_words, 1) * 10), np.log1p(r.n_repeat_words / max(r.n_words, 1))]
    by = {}
    for r in passed:
        for key in ((r.lang, r.source), (r.lang,), ()):
            by.setdefault(key, []).append(vector(r))
    limit, fits = quality_rules.chi2_quantile(5, 1 - 1e-5), {}
    for r in got:
        if r.base_failed:
            assert not r.kept
            continue
        key = next(k for k in ((r.lang, r.source), (r.lang,), ()) if not k or len(by[k]) >= quality_rules.MIN_GROUP)
        if key not in fits:
            fits[key] = plain_mcd(np.array(by[key]))
        mean, cov = fits[key]
        off = np.array(vector(r)) - mean
        d2 = off @ np.linalg.inv(cov) @ off
        assert np.isclose(d2, r.distance, rtol=1e-5) and r.kept == (d2 <= limit)
    assert any(not r.kept for r in passed) and sum(r.kept for r in passed) > 0.8 * len(passed)


def test_matrix_inverse(one):
    m = np.array([[4.0, 1, 0.5], [1, 3, 0.2], [0.5, 0.2, 2]])
    got = one(quality_rules.inverted(F.array(*[F.lit(float(v)) for v in m.ravel()]), 3))
    assert np.allclose(np.array(got["inverse"]).reshape(3, 3), np.linalg.inv(m)) and np.isclose(got["determinant"], np.linalg.det(m))


def shard_rows(spark, docs, path, **how):
    manifest = hilbert_shards.write_shards(docs, path, **how)
    return manifest, hilbert_shards.read_shards(spark, path).collect()


def test_hilbert_shards(docs, rows, empty, tmp_path, spark):
    manifest, got = shard_rows(spark, docs, str(tmp_path / "s"), shards=4, run_rows=9)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and set(by) == set(range(4))
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    curve = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert curve == sorted(curve)
    assert set(got[0].asDict()) == {*docs.columns, "curve", "tie", "size", "shard", "slot"}
    assert manifest.agg(F.sum("rows")).first()[0] == len(rows) and manifest.agg(F.max("rows")).first()[0] <= 9
    shard_rows(spark, empty, str(tmp_path / "e"))
    assert hilbert_shards.read_shards(spark, str(tmp_path / "e")).count() == 0
    assert hilbert_shards.read_shards(spark, str(tmp_path / "e"), "rows > 0").count() == 0


def test_readers_open_only_files_that_may_match(docs, rows, tmp_path, spark):
    path = str(tmp_path / "p")
    manifest, got = shard_rows(spark, docs, path, shards=4, run_rows=5)
    some = hilbert_shards.read_shards(spark, path, "max_size >= 4000", "size >= 4000")
    assert sorted(r.doc_id for r in some.collect()) == sorted(r.doc_id for r in got if r.size >= 4000) != []
    opened = [f for f in some.inputFiles() if "/data/" in f]
    assert 0 < len(opened) == manifest.where("max_size >= 4000").count() < manifest.count()
    assert {(r.shard, r.slot) for r in some.collect()} <= {(r.shard, r.slot) for r in got}
    none = hilbert_shards.read_shards(spark, path, "null_lang > 0", "lang is null")
    assert sorted(r.doc_id for r in none.collect()) == sorted(r.doc_id for r in got if r.lang is None) != []
    opened = {f.rsplit("/data/")[1] for f in none.inputFiles() if "/data/" in f}
    assert opened == {r.file for r in manifest.collect() if r.null_lang} and len(opened) < manifest.count()


def test_shards_hold_every_row(spark, docs, rows, tmp_path):
    odd = spark.createDataFrame([(None, "a", "en", "s"), (None, "a", "en", "s"), (None, None, None, None), (102, "same text here", "xx", "s"), (102, "other", "en", None)], "doc_id long, text string, lang string, source string")
    clash = {c: F.lit(f"own {c}") for c in ("file", "start", "rank", "copied", "least", "rows", "n")}
    whole = docs.select("doc_id", "text", "lang", "source").unionByName(odd).withColumns(clash)
    row = lambda r: repr((r.doc_id, r.text, r.lang, r.source, *[r[c] for c in clash]))
    for k, limit in enumerate((1000, 0)):
        _, got = shard_rows(spark, whole, str(tmp_path / f"w{k}"), shards=3, run_rows=7, broadcast_rows=limit)
        assert sorted(map(row, got)) == sorted(map(row, whole.collect()))
        assert len({(r.shard, r.slot) for r in got}) == len(got)
        at = {}
        for r in sorted(got, key=lambda r: (r.shard, r.slot)):
            at.setdefault(r.text or "", []).append(r)
        places = {(r.shard, r.slot): n for n, r in enumerate(sorted(got, key=lambda r: (r.shard, r.slot)))}
        for own in at.values():  # equal texts are neighbours, whatever their metadata
            own = sorted(places[r.shard, r.slot] for r in own)
            assert own == list(range(own[0], own[0] + len(own)))


def test_shards_of_one_repeated_row(spark, tmp_path):
    same = spark.createDataFrame([(7, "same", "en", "s")] * 50 + [(1, "other", "en", "s")], "doc_id long, text string, lang string, source string")
    _, got = shard_rows(spark, same, str(tmp_path / "r"), shards=16)
    counts = {}
    for r in got:
        counts.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 51 and {len(v) for v in counts.values()} == {3, 4} and len(counts) == 16
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())


def test_long_sources_get_cells_of_their_own(spark):
    names = [f"https://{a}.example.org/{y}" for a in "abcd" for y in (2023, 2024)]
    df = spark.createDataFrame([(k, f"text {k}", "en", names[k % 8]) for k in range(160)], "doc_id long, text string, lang string, source string")
    layout, _ = hilbert_shards.plan_shards(df, shards=4)
    keys = [f"v{n}" for n in sorted(names)]
    assert len({sum(k >= c for c in layout.cuts["source"]) for k in keys}) == 8


def test_token_files(spark, docs, rows, empty, tmp_path):
    library = Tokenizer.from_file(BPE)
    path = str(tmp_path / "t")
    token_files.write_token_files(docs, path, BPE, end_id=2, block_ids=500, every=16)
    got = sorted(token_files.read_token_files(spark, path, every=16, with_ids=True).collect(), key=lambda r: r.start)
    start = 0
    for r, (i, t, *_) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, np.frombuffer(r.ids, "<u4").tolist()) == (i, start, len(ids), brute.crc(ids), ids)
        start += len(ids)
    token_files.write_token_files(empty, str(tmp_path / "e"), BPE, end_id=2)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_packing(docs, rows, empty):
    library = Tokenizer.from_file(BPE)
    got = packing.pack_documents(docs, BPE, length=64, group_docs=30, with_ids=True).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in unique(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r.start)
        times = sum(r[0] == i for r in rows)
        assert sum(r.length for r in own) == times * len(ids)
        assert all(r.ids_crc32 == brute.crc(ids[r.start : r.start + r.length]) and np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length] and r.doc_tokens == len(ids) for r in own)
    assert sum(r.length for r in got) / (64 * len(by_seq)) > 0.9
    assert packing.pack_documents(empty, BPE).count() == 0


def test_equal_rows_are_dealt_to_all_groups(spark, tmp_path):
    n, most = 60_000, 20_000
    same = spark.range(n).repartition(6).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text that repeats").alias("text"))
    groups = []
    real = packing.written

    def spy(df, name):
        out = real(df, name)
        groups.extend(r["n"] for r in out.groupBy("grp").agg(F.count("*").alias("n")).collect() if name == "packed")
        return out

    packing.written = spy
    try:
        got = packing.pack_documents(same, BPE, length=1024, group_docs=most)
        assert got.agg(F.sum("length"), F.countDistinct("sequence_id"), F.max(F.col("offset") + F.col("length"))).first()[:1] == (n * got.first().doc_tokens,)
    finally:
        packing.written = real
    assert len(groups) == 3 and sum(groups) == n and max(groups) < 1.1 * most


def test_prefix_bpe(docs, rows, empty):
    library = tiktoken.Encoding("own3", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    texts = dict(unique(rows))
    got = prefix_bpe.bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        ids, text = library.encode_ordinary(texts[r.doc_id] or ""), (texts[r.doc_id] or "").encode()
        assert (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded_sha256) == (len(ids), ids, hashlib.sha256(text).hexdigest())
    assert prefix_bpe.bpe_round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_prefix_bpe_with_another_pattern(docs, rows):
    """A pattern that joins words: texts aren't cut before spaces then."""
    pattern = r"\S+(?: \S+)?|\s+"
    library = tiktoken.Encoding("own5", pat_str=pattern, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    texts = dict(unique(rows))
    for r in prefix_bpe.bpe_round_trip(docs.where("doc_id < 60 or doc_id > 90"), RANKS, pattern, with_ids=True).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id] or "")


def test_wide_vocabularies(spark, tmp_path):
    """Ids of more than 16 bits come back whole."""
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    assert not token_files.is_wide(BPE, 2) and token_files.is_wide(BPE, 70_000)
    token_files.write_token_files(df, str(tmp_path / "w"), BPE, end_id=70_000)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_token_files(spark, str(tmp_path / "w"), with_ids=True).collect()}
    assert got == {1: [*Tokenizer.from_file(BPE).encode("some text", add_special_tokens=False).ids, 70_000], 2: [70_000]}


def test_language_id(spark, docs, empty):
    rng = random.Random(2)
    lexicon = {"aa": ["the", "of", "and", "thing", "water"], "bb": ["der", "und", "wasser", "nicht", "eine"], "cc": ["que", "los", "agua", "pero", "una"]}
    rows = [(k, " ".join(rng.choice(words) for _ in range(60)), lang) for k, (lang, words) in enumerate(x for x in lexicon.items() for _ in range(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.learn_dictionaries(df.where(~language_id.is_held_out(F.col("doc_id"))))
    assert set(learned) == set(lexicon)
    said = language_id.predict_language(df.withColumn("score", F.lit("clash")), learned).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in said)
    hostile = {r.doc_id: r for r in language_id.predict_language(docs, learned).collect()}
    assert all(hostile[i].lang_pred == "und" and hostile[i].rejected for i in (0, 1, 5, 6))
    assert all(r.lang_pred == "und" for r in language_id.predict_language(docs, {}).collect())
    assert language_id.drop_unidentified(empty).count() == 0 and language_id.drop_unidentified(docs).columns == docs.columns
    clash = df.withColumns({"id_rejected": F.lit("mine"), "ID__score": F.lit("own")})
    kept = language_id.drop_unidentified(clash)
    assert kept.columns == clash.columns and {(r.id_rejected, r["ID__score"]) for r in kept.collect()} == {("mine", "own")}


def test_long_texts_keep_their_language(spark):
    rng = random.Random(6)
    alphabet = {"aa": "aeioubcdfg", "bb": "aeiouhklmn", "cc": "aeiouprstv"}
    lexicon = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(400)] for lang, letters in alphabet.items()}
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    short = [(k, text(words, 120), lang) for k, (lang, words) in enumerate(x for x in lexicon.items() for _ in range(40))]
    long = [(1000 + k, text(words, n), lang) for k, (lang, words, n) in enumerate((*x, n) for x in lexicon.items() for n in (20_000, 250_000))]
    both = [(2000, " ".join(text(lexicon[lang], 500) for _ in range(50) for lang in ("aa", "bb")), "aa")]
    assert max(len(t) for _, t, _ in long) > 1 << 20
    schema = "doc_id long, text string, lang string"
    learned = language_id.learn_dictionaries(spark.createDataFrame(short, schema))
    said = {r.doc_id: r for r in language_id.predict_language(spark.createDataFrame(short + long + both, schema), learned).collect()}
    assert all(said[i].lang_pred == lang and not said[i].rejected for i, _, lang in short + long)
    assert said[2000].score < 0.1 < min(said[i].score for i, _, _ in long)  # the last block counts as the first


def test_blocks_cover_a_text():
    for n in (0, 1, 4095, 4096, 4097, 8193, 100_000):
        data = random.Random(n).randbytes(n)
        parts = language_id.blocks(data)
        assert b"".join(parts) == data and max(map(len, parts)) <= language_id.BLOCK_BYTES and max(map(len, parts)) - min(map(len, parts)) <= 1


def test_urls(spark):
    urls = ["http://www.Example.com/en/1", "http://example.com/en/1", "https://a.example.com/en/x?q#f", "http://example.com/de/", "http://x.net/fr/1", "http://x.net/en/1", None, "no scheme", "http://", "http://example.com", "ftp://notexample.com/en/", "http://h?x", "a://b://c/d", "http://e.org/\u00e9/\n"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(0, urls[0], 1)], "page_id long, url string, host int")
    got = url_filter.url_verdicts(pages).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = brute.url_parts(urls[r.page_id])
        rule, verdict = brute.listed(host, path, url_filter.RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or verdict == r.verdict)
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


def test_url_rules_block_more_of_their_kind(spark):
    bad = [(f"http://s{i}.spam.org/win/{i}", True) for i in range(40)]
    good = [(f"http://s{i}.news.org/read/{i}", False) for i in range(40)] + [(f"http://s{i}.spam.org/read/{i}", False) for i in range(10)]
    labels = spark.createDataFrame(bad + good, "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://new.spam.org/win/x"), (2, "http://new.spam.org/read/x"), (3, "http://new.news.org/win/x")], "page_id long, url string")
    for limit in (1000, 0):
        got = {r.page_id: r.verdict for r in url_filter.url_verdicts(pages, labels=labels, min_confidence=0.9, broadcast_rows=limit).collect()}
        assert got[1] == "block" and got[2] == "allow"


def test_url_rules_learn_from_listed_pages_only(spark):
    rules = (("block", "bad.org", "/"), ("allow", "good.org", "/"))
    listed = [f"http://s{i}.bad.org/win/{i}" for i in range(60)] + [f"http://s{i}.good.org/read/{i}" for i in range(60)]
    others = [f"http://other.net/win/x{i}" for i in range(30)] + [f"http://other.net/read/x{i}" for i in range(30)]
    plain = [f"http://plain{i}.net/none/{i}" for i in range(5000)]
    pages = spark.createDataFrame(list(enumerate(listed + others + plain)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(pages, rules=rules).collect()}
    want = ["block"] * 60 + ["allow"] * 60 + ["block"] * 30 + ["allow"] * 5030
    assert [got[k] for k in range(len(want))] == want
    effect = {r.kind: (r.pages, r.blocked, r.allowed) for r in url_filter.rule_effect(pages, rules=rules).collect()}
    assert effect["open"] == (5060, 30, 30) and effect["held out, to block"][0] == effect["held out, to block"][1] > 0 == effect["held out, to allow"][1]


def rules_by_hand(rows, min_pages, min_confidence, max_tokens):
    """{(tokens, verdict): (confidence, pages)} by counting every combination."""
    freq = Counter(t for tokens, _ in rows for t in tokens)
    held = [(sorted((t for t in tokens if freq[t] >= min_pages), key=lambda t: (freq[t], t))[:max_tokens], bad) for tokens, bad in rows]
    seen = Counter((c, v) for tokens, bad in held for k in range(1, len(tokens) + 1) for c in combinations(sorted(tokens), k) for v in ("", "block" if bad else "allow"))
    return {(c, v): (n / seen[c, ""], seen[c, ""]) for (c, v), n in seen.items() if v and n >= min_pages and n / seen[c, ""] >= min_confidence}


def test_mined_rules_against_every_combination(spark):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(9)]
    rows = []
    for _ in range(400):
        tokens = sorted({rng.choice(words[: 3 + k]) for k in range(rng.randrange(6))})
        rows.append((tokens, rng.random() < (0.8 if {"t0", "t2"} <= set(tokens) else 0.25)))
    df = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    for limit, most in ((1000, None), (0, 3)):
        mined, items = url_filter.mine_rules(df, min_pages=12, min_confidence=0.5, max_items=most, broadcast_rows=limit)
        got, want = mined.collect(), rules_by_hand(rows, 12, 0.5, most)
        assert all(r.token == r.item for r in items.collect())
        assert len(got) == len(want) and {(tuple(r.items), r.verdict): (round(r.confidence, 9), r.pages) for r in got} == {k: (round(c, 9), n) for k, (c, n) in want.items()}
        assert any(r.verdict == "block" for r in got) and all(r.anchor in r.items for r in got)


def test_tokens_of_the_same_rows_are_one_item(spark):
    """Forty pieces that always occur together would have 2^40 combinations; any of them stands for all."""
    long = "/".join(f"piece{k}" for k in range(40))
    labels = [(f"http://a.org/{long}/x{i}", True) for i in range(60)] + [(f"http://b.org/read/y{i}", False) for i in range(60)]
    pages = spark.createDataFrame([(1, f"http://c.org/{long}"), (2, "http://c.org/piece7"), (3, "http://c.org/read"), (4, "http://c.org/other")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.said) for r in url_filter.url_verdicts(pages, labels=spark.createDataFrame(labels, "url string, blocked boolean"), min_confidence=0.9).collect()}
    assert got == {1: ("block", "block"), 2: ("block", "block"), 3: ("allow", "allow"), 4: ("allow", None)}


def test_a_long_address_is_read_whole(spark):
    labels = [(f"http://a.org/{'z' * 100_000}/bad{i % 2}/{i}", True) for i in range(30)] + [(f"http://b.org/{i}", False) for i in range(30)]
    pages = spark.createDataFrame([(1, f"http://c.org/{'y/' * 400_000}bad0"), (2, f"http://c.org/{'y/' * 400_000}good")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(pages, labels=spark.createDataFrame(labels, "url string, blocked boolean"), min_pages=2, min_confidence=0.9).collect()}
    assert got == {1: "block", 2: "allow"}

def test_url_query_against_every_combination(spark, sf_dir):
    """The query over a whole table: listed rules, then the surest of the rules mined from rated pages."""
    sf_dir = f"{Path(sf_dir).parent}/sf0.01"  # a smaller one has too few rated pages for a rule
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    rated = {r.doc_id: r.toxic == 1 or r.quality == 0 for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    parts = {r.page_id: brute.url_parts(r.url) for r in pages}
    number = lambda path: int(m[1]) if (m := re.search(r"/([0-9]+)(?:[.][a-z]+|/)?$", path)) else None
    labelled = [(p, rated[number(p[1])]) for p in parts.values() if number(p[1]) in rated]
    split = spark.createDataFrame([(h, p) for (h, p), _ in labelled], "host string, path string")
    held = {(r.host, r.path) for r in split.where(url_filter.is_held_out(F.col("host"), F.col("path"))).collect()}
    assert labelled and 0 < len(held) < len(labelled)

    def tokens(p):
        return sorted({f"h:{x}" for x in p[0].split(".") if x} | {f"p:{x}" for x in re.split(r"[^0-9A-Za-z]+", p[1]) if x})

    mined = rules_by_hand([(tokens(p), bad) for p, bad in labelled if p not in held], url_filter.MIN_PAGES, url_filter.MIN_CONFIDENCE, None)
    assert mined
    for r in queries.op6_url_rules(spark, sf_dir).collect():
        assert (r.host, r.path) == parts[r.page_id]
        rule, verdict = brute.listed(r.host, r.path, url_filter.RULES)
        own = set(tokens((r.host, r.path)))
        fit = max(((round(c, 9), n, -len(t), v, " ".join(t)) for (t, v), (c, n) in mined.items() if set(t) <= own), default=None)
        assert r.rule == rule and r.verdict == (verdict or (fit[3] if fit else "allow"))
        assert r.said == (None if rule else fit and fit[3])


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nx"), (2, 0, None, None), (2, 0, "assistant", ""), (None, 3, "assistant", "é😀"), (1, 2, "assistant", "b"), (4, 0, "odd\nrole\\n", "<\\|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    want = [(r or "", t or "") for c, _, r, t in sorted((x for x in rows if x[0] == 1), key=lambda x: x[1])]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
    learned = "".join(t for r, t in want if r == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[2].n_turns == 2 and got[None].loss_chars == 2 and got[4].turns_sha256 == hashlib.sha256("odd\nrole\\n\n<\\|im_end|>\n".encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0
