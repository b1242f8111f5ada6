"""Source divergence, phrase fingerprints and vector codes: hostile tables, brute force, the whole queries."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import oracle
import pytest
from test_llm_operators import SCHEMA, fixture_rows

from corpuslens.llm import divergence, phrase_prints, queries, vector_codes
from corpuslens.llm.shared import documents


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*fixture_rows(), (None, "a text without an id", None, None, None, None, None, None), (None, None, "en", "", "h", True, 1, "t")], SCHEMA).repartition(3)


def plain(rows):
    return sorted(map(tuple, rows))


def divergence_of(rows, least=3, top=200):
    """Rows of (text, lang, source) in plain Python."""
    rows = [(t or "", a or "", b or "") for t, a, b in rows]
    held, count, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in rows:
        terms = "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text).split(" ")
        terms = [t for t in terms if t]
        held[lang].update(set(terms))
        count[lang, source].update(terms)
    for lang in {r[1] for r in rows}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        sources = sorted({r[2] for r in rows if r[1] == lang})
        p = {}
        for s in [*sources, None]:
            n = {t: count[lang, s][t] if s is not None else sum(count[lang, x][t] for x in sources) for t in kept}
            p[s] = {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}
        f = lambda a, b, t: (p[a][t] - p[b][t]) ** 2 // p[b][t]
        for s in sources:
            pairs = [(-sum(f(s, o, t) for t in kept), o) for o in sources if o != s]
            terms = [(-f(s, None, t), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > p[None][t]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def test_divergence_of_a_hostile_table(spark, docs):
    want = divergence_of([(r.text, r.lang, r.source) for r in docs.collect()])
    assert {r[2] for r in want} == {"pair", "term"}
    assert plain(divergence.source_divergence(docs).collect()) == want
    assert plain(divergence.source_divergence(docs, block_uses=3).collect()) == want


def test_divergence_cases(spark):
    rows = [("ÄÖ Äö [x]Y_y 12 İ", "tr", "a"), ("ÄÖ y Y", "tr", "b"), ("ÄÖ y z", "tr", "b"), ("y", "tr", None), ("rare", "xx", "a"), (None, "xx", "b"), ("only", None, None)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    got = plain(divergence.source_divergence(frame).collect())
    assert got == divergence_of(rows)
    assert ("xx", "a", "pair", "b", 0, 1) in got and not [r for r in got if r[0] == ""]
    assert divergence.source_divergence(frame.limit(0)).collect() == []


def test_a_long_text_is_counted_whole(monkeypatch):
    rng = random.Random(3)
    words = [rng.choice(["ab", "Cd", "é", "x" * 70]) for _ in range(300_000)]
    text = " ".join(words).encode()
    want = Counter(w.lower().encode() if w != "é" else w.encode() for w in words)
    for size in (1, 50, 64 << 10, 4 << 20):
        monkeypatch.setattr(divergence, "SLICE", size)
        assert divergence.term_counts(text if size > 50 else text[:5000]) == (want if size > 50 else Counter(text[:5000].lower().split()))


def test_counts_are_handed_on_when_many_terms_are_held(spark, docs):
    rows = divergence.count_terms(docs, held=5)
    sums = lambda t: plain(t.groupBy("lang", "source", "term").sum("docs", "n").collect())
    assert sums(rows) == sums(divergence.count_terms(docs)) and rows.count() > divergence.count_terms(docs).count()


def test_shares_are_exact():
    n, size = np.array([0, 5, 10**14, 9 * 10**14]), np.array([7, 11, 9 * 10**14, 9 * 10**14 + 1])
    assert divergence.share(n, size).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n.tolist(), size.tolist(), strict=True)]


def fingerprint_of(text):
    out = set()
    for phrase in brute.phrase_set(text.encode()):
        h, power = 0, 1
        for byte in phrase:
            h, power = (h + (byte + 1) * power) % 2**64, power * phrase_prints.FACTOR % 2**64
        h = (h ^ (h >> 30)) * int(phrase_prints.MIX_1) % 2**64
        h = (h ^ (h >> 27)) * int(phrase_prints.MIX_2) % 2**64
        out.add(h >> 32)
    return sorted(out)[: phrase_prints.KEPT]


def alike(a, b):
    both = sorted({*a, *b})[: phrase_prints.KEPT]
    return len({*both} & {*a} & {*b}) / len(both) if both else 1.0


def check_prints(frame, rows):
    got = {r.doc_id: r for r in frame.collect()}
    assert len(got) == len(rows)
    for i, (text, edited, following) in brute.edited_pairs(rows).items():
        own, other, after = fingerprint_of(text), fingerprint_of(edited), fingerprint_of(following)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x:08x}" for x in own) and r.edited_fingerprint == "".join(f"{x:08x}" for x in other)
        assert math.isclose(r.near_edited, alike(own, other)) and math.isclose(r.near_next, alike(own, after))
    return got


def test_fingerprints_of_the_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    got = check_prints(queries.op12_phrase_fingerprints(spark, sf_dir), rows).values()
    long = [r for r in got if r.n_chars >= 300]
    assert len(long) > 100 and all(r.near_edited > r.near_next for r in long) and sum(r.near_edited for r in long) / len(long) > 0.5


def test_fingerprints_of_a_hostile_table(spark, docs):
    out = phrase_prints.phrase_fingerprints(docs).collect()
    assert len(out) == docs.count()
    of_text = defaultdict(set)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    for r in out:
        if len(set(texts[r.doc_id])) == 1:
            of_text[texts[r.doc_id][0]].add(r.fingerprint)
    assert all(len(x) == 1 for x in of_text.values())
    # repeated rows: 102 twice with one text, one after the other
    assert [r.near_next for r in out if r.doc_id == 102] == [1.0, 1.0]
    unique = {i: t[0] for i, t in texts.items() if len(t) == 1 and i is not None}
    rows = docs.where("doc_id in (%s)" % ",".join(map(str, unique)))
    check_prints(phrase_prints.phrase_fingerprints(rows), list(unique.items()))


def test_fingerprints_of_one_document_and_none(spark):
    one = spark.createDataFrame([(5, "abcabcabc", 1)], "doc_id long, text string, run int")
    r = phrase_prints.phrase_fingerprints(one).first()
    assert (r.near_next, r.n_chars, r.edited_sha256) == (1.0, 9, hashlib.sha256(b"abcabcabc").hexdigest())
    assert phrase_prints.phrase_fingerprints(one.limit(0)).collect() == []
    two = spark.createDataFrame([(5, None), (6, "")], "doc_id long, text string")
    assert [(r.fingerprint, r.near_edited, r.near_next) for r in phrase_prints.phrase_fingerprints(two).collect()] == [("", 1.0, 1.0)] * 2


def test_phrases_of_more_than_a_stretch(monkeypatch):
    data = ("ab" * 20_000 + "".join(random.Random(1).choices("abcdé", k=40_000))).encode()
    parse = phrase_prints.Parse()
    ends = np.array(parse.read(data)[1])
    whole = phrase_prints.phrase_hashes(data, ends)
    assert len(whole) == len(brute.phrase_set(data)) == len(set(whole.tolist()))
    phrase_prints.powers.cache_clear()
    monkeypatch.setattr(phrase_prints, "STRETCH", 4096)
    assert (phrase_prints.phrase_hashes(data, ends) == whole).all()
    phrase_prints.powers.cache_clear()
    monkeypatch.setattr(phrase_prints, "STRETCH", 100)  # the longest phrases have more bytes
    assert len(set(phrase_prints.phrase_hashes(data, ends).tolist())) == len(whole)
    phrase_prints.powers.cache_clear()


def test_reading_on_after_forgetting():
    parse = phrase_prints.Parse()
    parse.read(b"abababab")
    at = parse.at
    keys, _ = parse.read(b"zzzzabzz", 8)
    parse.forget(keys, at)
    _, more = parse.read(b"abcabc", 8)
    fresh = phrase_prints.Parse()
    assert fresh.read(b"abababababcabc")[1][-len(more) :] == more and fresh.trie == parse.trie


def test_fingerprints_of_a_megabyte(spark):
    text = " ".join(random.Random(2).choices(["alpha", "beta", "gamma", "ünï"], k=220_000))
    rows = [(3, text), (2, "short"), (1, text + "!")]
    assert len(text.encode()) > 1 << 20
    check_prints(phrase_prints.phrase_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")), rows)


@pytest.mark.parametrize("subtree", [1, 2, 7, 4096])
def test_the_trie_finds_nearest_entries(subtree):
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 400):
        leaves, times, which = vector_codes.distinct(parts := rng.integers(-3, 4, (n, 4)))
        book = rng.integers(-3, 4, (5, 4))
        entry, distance = vector_codes.nearest(leaves, book, subtree)
        every = ((leaves[:, None, :] - book[None]) ** 2).sum(2)
        assert (leaves[which] == parts).all() and times.sum() == n
        assert (entry == every.argmin(1)).all() and (distance == every.min(1)).all()
        assert (vector_codes.of_keys(vector_codes.as_keys(leaves), 4) == leaves).all()


VECTORS = "vec_id long, embedding array<float>, label int, code string, error int"


def test_vector_codes_of_a_hostile_table(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], i % 3 or None, "c", 1) for i in range(10, 90)]
    rows += [(1, None, 1, "c", 1), (2, [None] + [0.0] * 15, 1, "c", 1), (3, [float("nan")] + [0.0] * 15, 1, "c", 1), (4, [float("-inf")] + [0.0] * 15, None, "c", 1)]
    rows += [(12, rows[2][1], 2, "c", 1), (12, [0.5] * 16, 2, "c", 1), (None, [0.25] * 16, None, "c", 1), *[(200 + k, [1.5] * 16, 7, "c", 1) for k in range(60)]]
    frame = spark.createDataFrame(rows, VECTORS).repartition(5)
    con = duckdb.connect()
    con.sql("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", [r[:3] for r in rows])
    assert oracle.differences(vector_codes.compress_vectors(frame), queries.vector_codes_sql(), con) == ""
    got = oracle.differences(vector_codes.compress_vectors(frame, parts=4, entries=5, rounds=2), queries.vector_codes_sql(4, 5, 2), con)
    assert got == "" and vector_codes.compress_vectors(frame).count() == len(rows) - 4


def test_few_vectors_and_none(spark):
    three = spark.createDataFrame([(k, [k / 3] * 8, None, "c", 1) for k in range(3)], VECTORS)
    got = vector_codes.compress_vectors(three).orderBy("vec_id").collect()
    assert [(r.code, r.error, r.label_error) for r in got] == [("00" * 8, 0, 0), ("01" * 8, 0, 0), ("02" * 8, 0, 0)]
    assert vector_codes.compress_vectors(three.limit(0)).collect() == []
    assert vector_codes.compress_vectors(three.withColumn("embedding", three["embedding"].cast("array<double>"))).count() == 3
    with pytest.raises(Exception, match="equal lengths"):
        vector_codes.compress_vectors(spark.createDataFrame([(1, [0.0] * 8, 1, "", 1), (2, [0.0] * 16, 1, "", 1)], VECTORS).repartition(1)).collect()
