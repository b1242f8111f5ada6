"""The operators' plain parts against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from brute import components, hilbert_cells, shingles
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, pre_tokenizers

from corpuslens.llm import chat_format, huffman, packing, prefix_bpe
from corpuslens.llm.shingles import BlockIndex, shingle_sets
from corpuslens.llm.vocab import TextEncoder, byte_letter, library_encoder, read_ranks

RANKS, BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", "a\n \nb", "a  b   c ", "x \n y", " lead", "a<|endoftext|> b <|endoftext|>", "é   z", "tab\t x", "naïve café l'été  ", "a\u00a0 b", "it's 1234 don't—x", "\n", " \n\n  a", "日本語 テキスト", "word " * 3000, "x" * 5000, "😀 😀😀"]


@pytest.fixture(scope="module")
def rank_library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def slices(ids, bounds):
    return [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def test_encoders_give_the_libraries_ids(rank_library):
    whole = Tokenizer.from_file(BPE)
    texts = pa.array([*ODD, None])
    assert slices(*library_encoder(BPE).encode(texts)) == [whole.encode(x, add_special_tokens=False).ids for x in [*ODD, ""]]
    assert slices(*prefix_bpe.rank_encoder(RANKS, public_tokenizers.PATTERN)[1].encode(texts)) == [rank_library.encode_ordinary(x) for x in [*ODD, ""]]


def test_encoder_forgets_and_stays_right():
    encoder = library_encoder(BPE)
    encoder.remembered, before = 100, encoder.remembered
    try:
        words = ["alpha beta gamma", "delta epsilon zeta eta theta iota kappa", "alpha beta"]
        first = slices(*encoder.encode(pa.array(words)))
        assert slices(*encoder.encode(pa.array(words[::-1]))) == first[::-1]
    finally:
        encoder.remembered = before


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeinrst éß'.0 \n你😀", max_size=40))
def test_prefix_table_is_the_librarys_merging(text):
    merges, encoder = prefix_bpe.rank_encoder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own2", pat_str=r"[\s\S]+", mergeable_ranks=merges.ranks, special_tokens={})
    data = text.encode()
    if data and data not in merges.ranks:
        assert prefix_bpe.PrefixTable(merges, data).tokens() == library.encode_ordinary(text)


def test_appends_and_edits_equal_a_fresh_table():
    merges, _ = prefix_bpe.rank_encoder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    data = bytes(rng.choice(b"aeinrstho ") for _ in range(3000))
    table = prefix_bpe.PrefixTable(merges, data[:1000])
    table.append(data[1000:])
    assert table.last == prefix_bpe.PrefixTable(merges, data).last
    for _ in range(5):
        i = rng.randrange(1000)
        done = table.replace(i, i + 3, b"xyzzy")
        assert table.last == prefix_bpe.PrefixTable(merges, table.data).last
        assert done < 500  # entries behind the edit were kept


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=900), st.integers(9, 12), st.integers(1, 64))
def test_huffman_round_trip(ids, max_bits, every):
    ids = np.array(ids, np.int64)
    counts = np.bincount(ids, minlength=401)
    bits = huffman.code_lengths(counts, max_bits)
    assert (bits[counts > 0] > 0).all() and bits.max(initial=0) <= max_bits
    if (counts > 0).sum() > 1:
        assert sum(2.0 ** -int(b) for b in bits[bits > 0]) == 1
    payload, marks = huffman.encode_block(ids, huffman.canonical_codes(bits), bits, every)
    table = huffman.decode_table(bits, max_bits)
    assert huffman.decode_block(payload, marks, len(ids), table, max_bits, every).tolist() == ids.tolist()


def test_limited_code_is_optimal():
    import heapq

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 60)
    heap, cost = sorted(map(int, counts)), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert int((counts * huffman.code_lengths(counts, 18)).sum()) == cost


def test_first_fit_decreasing_against_a_scan():
    rng = random.Random(5)
    for n in (0, 1, 2, 7, 300):
        sizes = sorted((rng.randrange(1, 101) for _ in range(n)), reverse=True)
        rooms, want = [], []
        for s in sizes:
            k = next((i for i, r in enumerate(rooms) if r >= s), len(rooms))
            if k == len(rooms):
                rooms.append(100)
            want.append((k, 100 - rooms[k]))
            rooms[k] -= s
        bins, offsets, used = packing.first_fit_decreasing(np.array(sizes, np.int64), 100)
        assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == want and used == len(rooms)


def test_shingles_against_sets_of_words():
    texts = ["", None, "one", "A b", "a B", "a b c d e", "a b c d e f a b c d e", " lead\x0b a\u00a0b c d e f ", "É é e É é e É", "x " * 50]
    got = shingle_sets(pa.array(texts))
    want = [shingles(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_block_index_derives_exact_overlaps():
    rng = np.random.default_rng(2)
    lead = np.unique(rng.integers(0, 1000, 200))
    sets = [np.setdiff1d(np.union1d(lead, rng.integers(0, 1000, 9)), rng.choice(lead, 12)) for _ in range(20)]
    index, probe = BlockIndex(sets), np.setdiff1d(lead, rng.choice(lead, 30))
    want = [len(np.intersect1d(probe, s)) for s in sets]
    assert index.overlaps(probe, np.zeros(20)).tolist() == want
    assert (index.overlaps(probe, np.full(20, 10_000)) < 10_000).all()


TEXTS = st.text(alphabet="<|im_startend>\\ \nab", max_size=30) | st.sampled_from(["<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "<\\|im_end|>", "<\\\\|im_start|>", "<<|im_end|>", ""])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=4))
def test_chat_round_trip(turns):
    rendered = [chat_format.render(r, t) for r, t in turns]
    assert [x[:2] for x in chat_format.parse("".join(x[0] for x in rendered))] == turns
    for (_, text), (form, i, j) in zip(turns, rendered, strict=True):
        assert chat_format.unescape(form[i:j]) == text
        assert chat_format.START not in form[1:] and form.count(chat_format.END) == 1


@pytest.mark.parametrize(("dims", "bits"), [(3, 2), (2, 3), (3, 1)])
def test_hilbert_index_walks_neighbours(spark, dims, bits):
    from pyspark.sql import functions as F

    from corpuslens.llm.hilbert_shards import hilbert_index

    cells = hilbert_cells(dims, bits)
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cells)], ["k", *[f"d{i}" for i in range(dims)]])
    got = {r.k: r.h for r in df.select("k", hilbert_index([F.col(f"d{i}") for i in range(dims)], bits).alias("h")).collect()}
    assert got == {k: k for k in range(len(cells))}
    assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for x, y in zip(cells, cells[1:], strict=False))


def test_crc_helper_matches_zlib():
    from brute import crc

    assert crc([1, 2]) == zlib.crc32(b"\x01\x00\x00\x00\x02\x00\x00\x00")
    assert components([(1, "a b c d e"), (2, "A B C D E"), (3, "")]) == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_words_are_encoded_once_whatever_follows_them():
    found, asked = library_encoder(BPE), []
    encoder = TextEncoder(found.whole, lambda pieces: asked.extend(pieces) or found.words(pieces), tails=found.tails)
    odd = ["a, b", "x., y,, z!?", "it's, don't. 'll, x'.", "ción, ª. º, ǀ! ɐ, 日本, é.", "1, 2. 3.5, ½, ²,", ", . a", "<|endoftext|>, a<|endoftext|>. b", "", " ,", "a ,b a, ", "a,\nb c.\n d", "A.B, x́, ñ̃.", "a b" + "." * 300]
    ids, bounds = encoder.encode(pa.array(odd))
    model = Tokenizer.from_file(BPE)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [model.encode(x, add_special_tokens=False).ids for x in odd]
    asked.clear()
    encoder.encode(pa.array(["the palabra, palabra. palabra; palabra! palabra canción, canción"]))
    assert sorted(asked) == ["canción", "palabra", "the"]
    assert sorted(map(byte_letter, range(256))) == sorted(pre_tokenizers.ByteLevel.alphabet()) and byte_letter(32) == "Ġ"


def test_words_are_encoded_once_whatever_line_they_begin():
    found, asked = library_encoder(BPE), []
    encoder = TextEncoder(found.whole, lambda pieces: asked.extend(pieces) or found.words(pieces), tails=found.tails, lines=found.lines)
    encoder.encode(pa.array(["the palabra.\nOtra palabra%%% the.\npalabra?\nOtra, canción$$$\npalabra the***\ncanción## canción"]))
    assert sorted(asked) == ["\nOtra", "\ncanción", "\npalabra", "canción", "palabra", "the"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aeEst1é \n\n\t\r\x1c\x85\xa0'.,!%$<|>²ǀ́日😀", max_size=30), min_size=1, max_size=4))
def test_lines_and_tails_give_the_librarys_ids(texts):
    encoder, model = library_encoder(BPE), Tokenizer.from_file(BPE)
    assert slices(*encoder.encode(pa.array(texts))) == [model.encode(x, add_special_tokens=False).ids for x in texts]


def test_encoder_keeps_what_it_met_again():
    found, asked = library_encoder(BPE), []
    encoder = TextEncoder(found.whole, lambda pieces: asked.extend(pieces) or found.words(pieces), remembered=400)
    many = " ".join(f"w{i}" for i in range(100))
    for text in ("x alpha beta", "x beta", f"x {many}"):
        encoder.encode(pa.array([text]))
    asked.clear()
    ids, bounds = encoder.encode(pa.array(["x alpha beta w1"]))
    assert asked == ["alpha", "w1"]
    assert slices(ids, bounds) == [Tokenizer.from_file(BPE).encode("x alpha beta w1", add_special_tokens=False).ids]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aeEst1é \n\n\t\r\x1c\x85\xa0'.,!%$<|>²ǀ́日😀", max_size=30), min_size=1, max_size=4))
def test_lines_and_tails_give_the_rank_librarys_ids(rank_library, texts):
    encoder = prefix_bpe.rank_encoder(RANKS, public_tokenizers.PATTERN)[1]
    assert slices(*encoder.encode(pa.array(texts))) == [rank_library.encode_ordinary(x) for x in texts]


def test_rank_encoder_encodes_words_once_whatever_surrounds_them():
    found, asked = prefix_bpe.rank_encoder(RANKS, public_tokenizers.PATTERN)[1], []
    encoder = TextEncoder(found.whole, lambda pieces: asked.extend(pieces) or found.words(pieces), tails=found.tails, lines=found.lines)
    encoder.encode(pa.array(["the palabra.\nOtra palabra%%% <palabra palabra,\npalabra? palabra"]))
    assert sorted(asked) == ["\nOtra", "\npalabra", "<palabra", "palabra", "the"]
