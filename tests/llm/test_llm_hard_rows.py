"""Rows without an id and texts of over a megabyte, through every operator that reads documents; robust estimates against random starts."""

import hashlib
import random
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslens.llm import exact_dedup, language_id, ngram_join, packing, prefix_bpe, quality_rules, token_files
from corpuslens.llm.shared import documents
from corpuslens.llm.vocab import read_ranks

BPE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BIG = " ".join(random.Random(21).choices(["alpha", "beta", "Gamma", "ünï", "x1", "#tag", "delta\n", "epsilon"], k=230_000))
ROWS = [(None, "a text without an id"), (None, "a text without an id"), (None, None), (1, BIG), (2, "a text without an id"), (3, None), (4, BIG + " end")]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(BIG.encode()) > 1 << 20
    return spark.createDataFrame([(i, t, "en", "s") for i, t in ROWS], "doc_id long, text string, lang string, source string").repartition(3)


def library_ids():
    model = Tokenizer.from_file(BPE)
    return {t: model.encode(t or "", add_special_tokens=False).ids for _, t in ROWS}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_statistics_and_sets(docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_verdicts(docs).collect())
    assert got == Counter((i, *brute.statistics(t or "")) for i, t in ROWS)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect())
    size = {t: len(brute.shingles(t)) for _, t in ROWS}
    # copies with and without an id are one component, named by its least id; the two long texts are near
    assert got == Counter([(None, 1, 2), (None, 1, 2), (None, 0, None), (1, size[BIG], 1), (2, 1, 2), (3, 0, 3), (4, size[BIG + " end"], 1)])


def test_token_files_and_packing(spark, docs, tmp_path):
    ids = library_ids()
    token_files.write_token_files(docs, str(tmp_path / "t"), BPE, end_id=2)
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, None, 1, 2, 3, 4]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids[t]) + 1, crc([*ids[t], 2])) for i, t in ROWS)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packing.pack_documents(docs, BPE).collect())
    whole = [(i, [*ids[t], 0]) for i, t in ROWS]
    assert pieces == Counter((i, k, len(x[k : k + 1024]), crc(x[k : k + 1024]), len(x)) for i, x in whole for k in range(0, len(x), 1024))


def test_round_trip_and_copies(docs):
    library = tiktoken.Encoding("own5", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in prefix_bpe.bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN).collect())
    want = {t: library.encode_ordinary(t or "") for _, t in ROWS}
    assert got == Counter((i, len(want[t]), sha(np.array(want[t], "<u4").tobytes()), sha((t or "").encode())) for i, t in ROWS)
    rows = exact_dedup.exact_duplicates(docs, keep="largest").collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == Counter([(None, 2, 3), (None, 2, 3), (2, 2, 3), (None, 3, 2), (3, 3, 2), (1, 1, 1), (4, 4, 1)])
    assert {r.doc_id for r in rows if r.kept} == {1, 2, 3, 4} and {r.text_sha256 for r in rows if r.doc_id == 1} == {sha(BIG.encode())}


def test_rejection_is_a_margin_over_all_blocks(spark, sf_dir):
    """Sizes by the library with the same prepared dictionaries: language, score and rejection agree to the last bit."""
    import zstandard

    docs = documents(spark, sf_dir)
    learned = language_id.learn_dictionaries(docs.where(~language_id.is_held_out(F.col("doc_id"))))
    mixed = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(["ok", "a", "la", "die", "no no no", "x" * 9000])], "doc_id long, text string")
    said = language_id.predict_language(docs.select("doc_id", "text").unionByName(mixed), learned).collect()
    by = [zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=language_id.prepared(c, language_id.LEVEL), write_checksum=False, write_content_size=False, write_dict_id=False) for c in learned.values()]
    seen = Counter()
    for r in said:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        data = r.text.lower().encode()
        n = max(1, -(-len(data) // language_id.BLOCK_BYTES))
        sizes = [sum(len(c.compress(data[len(data) * k // n : len(data) * (k + 1) // n])) for k in range(n)) for c in by]
        best, second = sorted(sizes)[:2]
        assert (r.lang_pred, r.score, r.rejected) == (list(learned)[sizes.index(best)], 1 - best / second, 1 - best / second < language_id.MIN_MARGIN)
        seen[r.rejected] += 1
    assert seen[True] and seen[False]


def test_estimates_against_random_starts(spark):
    """Of 500 random starts, none finds a determinant much under that of the three fixed ones."""
    rng = np.random.default_rng(5)
    d, n, share = len(quality_rules.FEATURES), 240, 0.75
    floors = np.array([f for _, f in quality_rules.FEATURES.values()])
    x = rng.normal(size=(n, d)) * floors * 4
    x[: n // 6] += floors * 30 * rng.choice([-1, 1], d)
    frame = spark.createDataFrame([("g", r.tolist()) for r in x], "grp string, x array<double>")
    got = quality_rules.robust_estimates(frame, "grp", share=share).first().determinant
    scale = quality_rules.consistency(d, share)

    def fit(rows, factor):
        cov = np.cov(rows.T, bias=True) * factor + np.diag(floors**2)
        return rows.mean(axis=0), np.linalg.inv(cov), np.linalg.det(cov)

    found = []
    for _ in range(500):
        mean, inverse, det = fit(x[rng.choice(n, d + 2, replace=False)], scale)
        last = np.inf
        for _ in range(60):
            off = x - mean
            d2 = np.einsum("ij,jk,ik->i", off, inverse, off)
            mean, inverse, det = fit(x[np.argsort(d2)[: int(np.ceil(share * n))]], scale)
            if det >= last * (1 - 1e-9):
                break
            last = det
        found.append(det)
    assert got <= 1.05 * min(found) and got >= 0.95 * min(found)
