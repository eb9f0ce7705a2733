import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from chronogeo.llm import collocations, queries, secret_links, signature_trees, token_alignment

DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: A table whose other columns have the names that the operators use inside.
CLASHING = "doc_id long, text string, lang string, chunk string, pair string, n string, id string, key string, label string, hi string, word string, digest string"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def oracle(name, rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string())}))
    return con.sql(queries.ORACLE[name])


# --- alignment of tokenizers


def aligned_by_force(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table, names = token_alignment.byte_table(), {i: t for t, i in a.get_vocab().items()}
    out, held = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xs = [bytes(table[c] for c in names[i]) for i in x]
            ys = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(xs) == b"".join(ys) == (" " + text).encode():
                ends = [np.cumsum([len(t) for t in v]).tolist() for v in (xs, ys)]
                i = j = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
                    groups.append((x[i:k], y[j:m]))
                    i, j = k, m
        links = [(p, q) for u, v in groups for p in u for q in v]
        held.update(set(links))
        out.append((doc_id, groups, links))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    text = lambda g: ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in g)
    return sorted(
        ((d, sum(len(u) for u, _ in g), sum(len(v) for _, v in g), len(g), len(l), sum(held[p] == best[p[0]] for p in l), sum(held[p] for p in l), hashlib.sha256(text(g).encode()).hexdigest() if g else "") for d, g, l in out),
        key=repr,
    )


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a\x00b ▁ x"), (5, "a\x00b  x\n\n y\r\n\tz\x0b \x0c　w \x85\xa0q   "), (6, "<|endoftext|> <s> </s> <unk> <0x41>"), (7, "\U0001f600﻿ á ﬁ" * 30),
    (7, "\n"), (None, "x"), (8, "the " * 4000), (9, "ab" * 3000), (10, "　　a\r b\r\n c"), (11, "日本語テキスト\U0001f9d1‍\U0001f4bb" * 40), (8, "the " * 4000), (12, "Zürich naïve façade, cliché's; x=1+2"),
]


@pytest.mark.parametrize("chunk_bytes", [64, 1 << 20])
def test_alignment_equals_brute_force(spark, chunk_bytes):
    rows = ODD + [(r.doc_id + 100, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    got = token_alignment.linked(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=chunk_bytes)
    assert rows_of(got) == aligned_by_force(rows)


def test_alignment_groups_and_edges(spark):
    df = spark.createDataFrame([(1, "Hello wörld", *"xxxxxxxxxx"), (2, None, *"xxxxxxxxxx")], CLASHING)
    got = {r.doc_id: r for r in token_alignment.grouped(df).collect()}
    assert got[2].groups == "" and got[2].n_a == 0
    parts = [g.split("|") for g in got[1].groups.split(";")]
    assert len(parts) == got[1].n_groups and sum(len(a.split(",")) for a, _ in parts) == got[1].n_a and sum(len(b.split(",")) for _, b in parts) == got[1].n_b
    assert token_alignment.linked(df).count() == 2 and token_alignment.linked(df.limit(0)).collect() == []


def test_alignment_of_long_texts_in_parts():
    v = token_alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdeé　\n") for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    whole = v.text(text)
    assert [u for part in v.parts(text, 100) for u in part] == [u for part in v.parts(text) for u in part]
    size, token_alignment.PART_CHARS = token_alignment.PART_CHARS, 5_000
    try:
        cut = token_alignment.Aligner.text(v, text)
    finally:
        token_alignment.PART_CHARS = size
    assert whole[3] == cut[3] and all((a == b).all() for a, b in zip(whole[:3], cut[:3]))
    wide = token_alignment.links_of_group(np.array([5, 5, 6]), np.array([1, 2, 2]))
    assert dict(zip(zip((wide[0] >> 32).tolist(), (wide[0] & 0xFFFFFFFF).tolist()), wide[1].tolist())) == {(5, 1): 2, (5, 2): 4, (6, 1): 1, (6, 2): 2}


# --- phrases


def phrase_rows(n=700, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Zürich", "<|x|>", "a\xa0b", "é"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(rng.choice(["new York city", "new york", "State of the Art", "of the", rng.choice(words), rng.choice(words), f"rare{rng.randint(0, 400)}"]))
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for p in parts)
        rows.append((i, text, rng.choice(["en", "de", None, "und"])))
    return rows + [(None, None, "en"), (n, "", None), (0, rows[0][1], "fr"), (n + 1, " \t\n.,", "en")]


@pytest.mark.parametrize("least,chunk", [(30, 1 << 21), (30, 300), (3, 200)])
def test_phrases_equal_sql(spark, least, chunk):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    sql = queries.ORACLE["op12_collocations"].replace(f">= {collocations.MIN_COUNT}", f">= {least}")
    con = duckdb.connect()
    con.register("documents", pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())))}))
    want = con.sql(sql)
    got = collocations.mined(df, least=least, chunk_words=chunk)
    assert rows_of(got, *want.columns) == sorted(want.fetchall(), key=repr) and got.count() > 10
    few = collocations.mined(df, least=least, chunk_words=chunk, top=3)
    assert rows_of(few) == rows_of(got.filter("rank <= 3"))


def test_a_full_bit_table_loses_nothing(spark, monkeypatch):
    df = spark.createDataFrame(phrase_rows(300), "doc_id long, text string, lang string")
    want = rows_of(collocations.mined(df, least=5))
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)  # the table stays at its least size; all keys may pass
    assert rows_of(collocations.mined(df, least=5)) == want


def test_phrases_edges(spark):
    df = spark.createDataFrame([(i, "Big deal", None, *"xxxxxxxxx") for i in range(40)], CLASHING)
    assert rows_of(collocations.mined(df)) == [("und", 1, "big deal", 40, 40, 40, 80, 1000000)]
    assert collocations.mined(df.limit(0)).collect() == [] and collocations.mined(df.limit(3)).collect() == []
    ids = [np.array([7, 1, 7, 70000, 1], np.int32), np.array([2, 9, 1, 5, 9], np.int32)]
    assert collocations.radix_order(ids).tolist() == [1, 4, 2, 0, 3]
    hi, lo, n = collocations.packed_runs(ids)
    assert (hi >> 32).tolist() == [1, 7, 7, 70000] and (hi & 0xFFFFFFFF).tolist() == [9, 1, 2, 5] and n.tolist() == [2, 1, 1, 1] and not lo.any()
    assert list(collocations._parts(b"ab. cd e.f", 1)) == [b"ab.", b" cd e.", b"f"]


def test_scores_beyond_64_bits(spark):
    a = 6 * 10**15
    rows = [(1 << 32, 0, 2 * a), (2 << 32, 0, 2 * a), ((1 << 32) | 2, 0, a + 1)]
    got = collocations.scored(spark.createDataFrame(rows, "hi long, lo long, n long")).collect()
    assert len(got) == 1 and got[0].score == 2_000_000 * (a + 1) // (4 * a)


# --- Jaccard join


def near_rows(n=250, seed=3):
    rng = random.Random(seed)
    rows = []
    for g in range(n // 10):
        base = [f"v{rng.randint(0, 900)}" for _ in range(rng.choice([1, 2, 3, 8, 11, 12, 13, 40, 120, 400]))]
        for k in range(10):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 99)}"
            if rng.random() < 0.2:
                words = words + base[: len(base) // 10]
            rows.append((g * 10 + k, rng.choice([" ", "\n", "  "]).join(words).upper() if k % 3 else " ".join(words), "en"))
    return rows + [(n, None, "en"), (n + 1, "", "en"), (n + 2, " \t", None), (n + 3, rows[5][1], "de")]


@pytest.mark.parametrize("crowd", [2048, 4])
def test_joined_sets_equal_sql(spark, crowd):
    rows = near_rows()
    got = signature_trees.joined(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7), crowd_sets=crowd)
    want = oracle("op13_ngram_jaccard", rows)
    assert rows_of(got, *want.columns) == sorted(want.fetchall(), key=repr)
    assert got.filter("doc_id <> component_id").count() > 20


def test_join_bounds_and_edges(spark):
    words = [f"t{i}" for i in range(400)]
    text = lambda n: " ".join(words[:n])
    rows = [(1, text(11)), (2, text(12)), (11, text(101)), (12, text(112)), (13, text(113)), (21, "a b"), (22, "A  B"), (23, "a b c"), (31, None), (32, ""), (None, "q r s"), (None, "Q R s"), (41, text(11))]
    df = spark.createDataFrame([(*r, *"xxxxxxxxxx") for r in rows], CLASHING)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_trees.joined(df).filter("doc_id IS NOT NULL").collect()}
    assert got[1] == (9, 1) and got[2] == (10, 1) and got[41] == (9, 1)  # nine of ten are enough
    assert got[11][1] == 11 and got[12] == (110, 11) and got[13] == (111, 11)  # 99 of 110, and 110 of 111 beyond
    assert got[21] == got[22] == (1, 21) and got[23] == (1, 23) and got[31] == (0, 31) and got[32] == (0, 32)
    assert [r.component_id for r in signature_trees.joined(df).filter("doc_id IS NULL").collect()] == [None, None]
    assert signature_trees.joined(df.limit(0)).collect() == []


def test_linked_sets_share_a_segment():
    rng = np.random.default_rng(2)
    for _ in range(300):
        size = int(rng.integers(9, 300))
        own = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        apart = int(rng.integers(0, max(1, len(own) // 9)))
        other = np.unique(np.concatenate([own[rng.permutation(len(own))[: len(own) - apart // 2]], rng.integers(0, 1 << 63, apart - apart // 2).astype(np.uint64)]))
        same = len(np.intersect1d(own, other))
        if 100 * same >= 90 * (len(own) + len(other) - same) and signature_trees.set_digest(own) != signature_trees.set_digest(other):
            assert len(np.intersect1d(signature_trees.segment_keys(own), signature_trees.segment_keys(other)))


def test_tree_links_all_that_is_linked():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(12):
        base = np.unique(rng.integers(0, 1 << 40, int(rng.integers(5, 400))).astype(np.uint64))
        for _ in range(int(rng.integers(1, 25))):
            gone = rng.random(len(base)) < rng.choice([0, 0.02, 0.05])
            sets.append(np.unique(np.concatenate([base[~gone], rng.integers(0, 1 << 40, int(gone.sum())).astype(np.uint64)])))
    order = rng.permutation(len(sets)).tolist()
    sets = [sets[i] for i in order]

    def classes(links):
        label = list(range(len(sets)))
        for a, b in links:
            x, y = label[a], label[b]
            label = [x if v == y else v for v in label]
        return {frozenset(i for i, v in enumerate(label) if v == w) for w in set(label)}

    def linked(a, b):
        same = len(np.intersect1d(a, b))
        return 100 * same >= 90 * (len(a) + len(b) - same)

    found = signature_trees.links_of_tree(sets)
    assert all(linked(sets[a], sets[b]) for a, b in found)
    assert classes(found) == classes([(a, b) for a in range(len(sets)) for b in range(a) if linked(sets[a], sets[b])])


# --- very long texts


def test_secrets_of_a_long_text(spark):
    n = 60_000
    text = " ".join(f"token={i:06d}ab" if i % 3 else f"user=bob{i} é" for i in range(n))
    df = spark.createDataFrame([(1, text, "en", "s", 0), (2, None, "en", "s", 0)], DDL)
    r = secret_links.reported(df).filter("doc_id = 1").first()
    assert r.n_assign == n - (n + 2) // 3
    at = text.index("token=030001ab")
    assert f"assign:{at}:{at + 14}" in r.spans and r.spans.count("login:") == (n + 2) // 3
    done = {x.doc_id: x.text for x in secret_links.redact_rows(spark.createDataFrame([(1, " ".join(f"token={i:06d}ab" for i in range(n)), "en", "s", 0), (2, None, "en", "s", 0)], DDL)).collect()}
    assert done[1] == " ".join(["[assign]"] * n) and done[2] is None
