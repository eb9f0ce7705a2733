import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronogeo.llm import adaptive_ann, components, mixing, piece_codec, secret_links, simhash_pivots, substring_graph


def table(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", 3) for i, t in zip(ids, texts)], "doc_id bigint, text string, lang string, source string, row string, spans string, fp int")


# -- substring dedup --


def slow_dedup(rows):
    words = {i: (t or "").encode().split() for i, t in rows}
    seen, gone = {}, {i: set() for i in words}
    for i in sorted(words):
        for k in range(len(words[i]) - 19):
            w = tuple(words[i][k : k + 20])
            if w in seen:
                gone[i] |= set(range(k, k + 20))
            else:
                seen[w] = (i, k)
    return {i: (len(w), len(gone[i]), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone[i])).hexdigest()) for i, w in words.items()}


@pytest.mark.parametrize("seed", range(4))
def test_substring_dedup_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3 if seed == 3 else 60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 70))] for _ in range(6)]
    texts = [None, "", "a " * 60, "one two"]
    for _ in range(40):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    texts += texts[10:16]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_graph.deduplicated(table(spark, texts)).collect()}
    assert got == slow_dedup(rows)
    if seed == 0:  # a full bit table changes nothing
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_graph.deduplicated(table(spark, texts), bits=64).collect()}
        assert got == slow_dedup(rows)


def test_substring_dedup_edges(spark):
    long = " ".join(f"x{i}" for i in range(50))
    other = " ".join(f"y{i}" for i in range(30)) + " " + long
    rows = substring_graph.deduplicated(table(spark, [long, long, other, long, long], [5, 5, 5, None, 7])).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_removed"]) for r in rows) == [(-1, 0), (5, 50), (5, 50), (5, 50), (7, 50)]
    assert substring_graph.deduplicated(table(spark, ["x"]).limit(0)).count() == 0


def test_substring_dedup_of_rows_without_id(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [f"a {passage}", f"b c {passage}"]
    for t in texts[:2]:  # texts of their own words that share 16 bits of a hash with these
        own = " ".join(f"q{len(texts)}.{i}" for i in range(40))
        texts.append(next(x for x in (f"{own} {k}" for k in range(10**6)) if (zlib.crc32(x.encode()) ^ zlib.crc32(t.encode())) & 0xFFFF == 0))
    texts.append(f"{passage} {own}")
    rows = substring_graph.deduplicated(table(spark, texts, [None] * 4 + [4])).collect()
    got = sorted((r["n_words"], r["n_removed"]) for r in rows)
    assert got[2:] == [(41, 0), (41, 0), (70, 70)]
    assert sorted(n for _, n in got[:2]) == [0, 30]  # one of the two that share the passage keeps it


def test_substring_dedup_of_repeated_and_other_ids(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [f"a {passage}"]
    own = " ".join(f"q{i}" for i in range(40))  # words of its own; 16 bits of a hash agree with those of the other text
    texts.append(next(x for x in (f"{own} {k}" for k in range(10**6)) if (zlib.crc32(x.encode()) ^ zlib.crc32(texts[0].encode())) & 0xFFFF == 0))
    texts.append(passage)
    rows = substring_graph.deduplicated(table(spark, texts, [7, 7, 3])).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in rows) == [(3, 30, 0), (7, 31, 30), (7, 41, 0)]
    named = spark.createDataFrame([("b", f"x {passage}"), ("a", passage), (None, None), ("10", f"{passage} y"), ("10", f"{passage} y")], "doc_id string, text string")
    rows = substring_graph.deduplicated(named).collect()
    assert sorted((r["doc_id"] or "", r["n_words"], r["n_removed"]) for r in rows) == [("", 0, 0), ("10", 31, 0), ("10", 31, 0), ("a", 30, 30), ("b", 31, 30)]


def test_paths_compact(spark):
    # b -> c -> d always in a row; a and e also occur elsewhere; f goes on at another place than its first coordinate.
    rows = [("a", 2, 1, 0, 3, "b"), ("b", 3, 1, 2, 2, "c"), ("c", 1, 1, 5, 2, "d"), ("d", 4, 1, 6, 2, ""), ("e", 1, 1, 10, 3, "f"), ("f", 2, 0, 4, 3, "g"), ("g", 2, 2, 6, 3, "")]
    code = {x: i + 1 for i, x in enumerate("abcdefg")} | {"": 0}
    nodes = spark.createDataFrame([(-code[c], code[c], n, doc, at, times, code[nxt]) for c, n, doc, at, times, nxt in rows], "seed bigint, content bigint, n int, doc bigint, at int, times bigint, following bigint")
    got = sorted((r["content"], r["seed"], r["windows"], r["src_doc"], r["src_at"]) for r in substring_graph.compacted(nodes).collect())
    assert got == [(1, -1, 2, 1, 0), (2, -2, 8, 1, 2), (5, -5, 1, 1, 10), (6, -6, 2, 0, 4), (7, -7, 2, 2, 6)]
    chain = spark.createDataFrame([(i, i + 1, 1, 5, i, 2, (i + 2) if i < 36 else 0) for i in range(37)], nodes.schema)
    assert [(r["content"], r["windows"], r["src_at"]) for r in substring_graph.compacted(chain).collect()] == [(1, 37, 0)]


def test_spans_are_proved_at_their_sources(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = table(spark, [passage, f"x {passage}", " ".join(f"q{i}" for i in range(30))])
    false = spark.createDataFrame([(1, 1, 11, 0, 0), (2, 0, 11, 0, 0)], "doc bigint, at int, n int, src_doc bigint, src_at int")
    spans, salts = substring_graph.repeated_spans, []

    def wrong_at_first(rows, bits, salt):
        salts.append(salt)
        return spans(rows, bits, salt) if salt else false

    monkeypatch.setattr(substring_graph, "repeated_spans", wrong_at_first)
    got = sorted((r["doc_id"], r["n_removed"]) for r in substring_graph.deduplicated(docs).collect())
    assert salts == [0, 1] and got == [(0, 0), (1, 30), (2, 0)]


def test_long_words_keep_apart():
    odd = ["ab"[bin(i).count("1") & 1] for i in range(4096)]  # sums of powers modulo 2^64 can't tell this word from its mirror
    words = "".join(odd).encode(), "".join(odd).translate(str.maketrans("ab", "ba")).encode()
    assert substring_graph.word_hashes(words[0])[0] != substring_graph.word_hashes(words[1])[0]


# -- SimHash --


def slow_fingerprint(t):
    w = bytes(t or "", "utf-8").lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    out = 0
    for k in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(x, 42) >> k & 1 for x in s) > len(s):
            out |= 1 << k
    return out if s else 0


def slow_components(ids, fps):
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            for b in range(len(ids)):
                if (fps[a] ^ fps[b]).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return [min(i for i, m in zip(ids, label) if m == k) for k in label]


def test_simhash_matches_brute_force(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(120)) for _ in range(12)]
    texts = [None, "", "One Two", "one two", "ÄB cd ef gh"] + base
    for b in base:
        for _ in range(4):
            w = b.split()
            w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    texts += base[:3]
    rows = {r["doc_id"]: r for r in simhash_pivots.marked(table(spark, texts)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [rows[i]["fingerprint"] for i in range(len(texts))] == ["%016x" % f for f in fps]
    assert [rows[i]["component_id"] for i in range(len(texts))] == slow_components(list(range(len(texts))), fps)


@pytest.mark.parametrize(("n_blocks", "crowd"), [(6, 16_384), (8, 16_384), (6, 4), (7, 30)])
def test_links_join_all_that_is_near(spark, n_blocks, crowd):
    rng = random.Random(n_blocks)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.choice([3, 10, 90])):  # chains, and groups over the size of a small one
            f ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3))) & ((1 << 64) - 1)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash_pivots.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), n_blocks=n_blocks, crowd=crowd)
    labels = {r["node"]: r["label"] for r in components.component_labels(links).collect()}
    got = [labels.get(f, f) for f in signed]
    want = slow_components(signed, fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_crowded_keys_are_cut_into_bounded_groups(spark):
    rows = spark.createDataFrame([(0, 5, f) for f in range(2000)] + [(1, 5, f) for f in range(50)], "choice int, bits bigint, fp bigint")
    chunked, group = simhash_pivots._in_chunks(rows, 100)
    found = chunked.groupBy(*group).agg(F.collect_set("fp").alias("fps")).collect()
    assert max(len(r["fps"]) for r in found) < 300
    together = {f for r in found if r["choice"] == 0 for f in r["fps"]}
    chunk_of = {r["fp"]: r["c"] for r in rows.filter("choice = 0").select("fp", F.pmod(F.xxhash64("fp"), F.lit(20)).alias("c")).collect()}
    assert len(together) == 2000 and {(r["i"], r["j"]) for r in found if r["choice"] == 0} == {(i, j) for i in range(20) for j in range(i + 1, 20)}
    assert all({chunk_of[f] for f in r["fps"]} <= {r["i"], r["j"]} for r in found if r["choice"] == 0)
    assert [len(r["fps"]) for r in found if r["choice"] == 1] == [50]


def test_large_groups_link_what_is_near():
    rng = np.random.default_rng(4)
    fps = np.unique(np.array([0xF0F0] * 300, np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    pairs = simhash_pivots._large_group(fps, 4)
    assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 4 for a, b in pairs)
    seen, more = {0}, True
    while more:
        grown = seen | {b for a, b in pairs if a in seen} | {a for a, b in pairs if b in seen}
        more, seen = grown != seen, grown
    assert len(seen) == len(fps)


def test_components_of_a_long_chain(spark):
    rows = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 7)], "a bigint, b bigint")
    assert {(r["node"], r["label"]) for r in components.component_labels(rows).collect()} == {(i, 0) for i in range(41)}
    assert components.component_labels(rows.limit(0)).count() == 0


def test_one_of_each_class_stays(spark):
    long = " ".join(f"x{i}" for i in range(80))
    other = " ".join(f"y{i}" for i in range(80))
    docs = table(spark, [long, long, other, long, other, None], [4, 4, 9, 2, 9, None])
    kept = simhash_pivots.first_rows(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == [-1, 2, 9]
    mixed = table(spark, [long, other, "different words here now", None], [4, 4, 4, 5])
    assert sorted(str(r["text"])[:4] for r in simhash_pivots.first_rows(mixed).collect()) == ["None", "diff", "x0 x", "y0 y"]
    assert simhash_pivots.first_rows(docs.limit(0)).count() == 0


# -- mixing --


def test_mix_near_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), s) for i, s in enumerate(["a"] * 700 + ["b"] * 300 + [None] * 50 + ["c"] * 200)] + [(9000, None, "d"), (9001, "", "d"), (9001, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("copies", F.lit("clash")).withColumn("row", F.lit(1))
    got = mixing.copies(docs).collect()
    assert len(got) == len(rows)
    sources = {}
    for r in got:
        s = sources.setdefault(r["source"], [r["source_size"], r["target"], 0])
        s[2] += r["copies"] * r["size"]
        assert 0 <= r["copies"] <= 3
    assert sum(s[1] for s in sources.values()) == pytest.approx(sum(s[0] for s in sources.values()))
    for size, target, taken in sources.values():
        assert target <= 3 * size and abs(taken - target) <= 60 + 0.01 * target
    assert sorted(map(str, got)) == sorted(map(str, mixing.copies(docs).collect()))
    out = mixing.emit_rows(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.emit_rows(docs.limit(0)).count() == 0


def test_number_of_ranges_changes_no_mix(spark, monkeypatch):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(["w"] * rng.randint(0, 9)), rng.choice("aab")) for i in range(600)], "doc_id bigint, text string, source string")
    want = sorted(map(str, mixing.copies(docs).collect()))
    for bits in (1, 11):
        monkeypatch.setattr(mixing, "salt_bits", lambda n, bits=bits: bits)
        assert sorted(map(str, mixing.copies(docs).collect())) == want


def test_ranges_grow_with_the_root_of_the_rows():
    assert mixing.salt_bits(0) == mixing.salt_bits(10**6) == 6
    assert 2 ** mixing.salt_bits(10**11) == 16384


def test_mix_hot_equal_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 50 + [(2, "a b", "t")] * 5, "doc_id bigint, text string, source string")
    rows = mixing.copies(docs).collect()
    assert mixing.emit_rows(docs).count() == sum(r["copies"] for r in rows)
    texts = [f"a b {i}" for i in range(900)]
    docs = spark.createDataFrame([(None, t, "s") for t in texts] + [(1, t, "t") for t in texts[:90]] + [(i, "w w", None) for i in range(300)], "doc_id bigint, text string, source string").repartition(7)
    rows = mixing.copies(docs).collect()
    assert len(rows) == 1290
    taken = {}
    for r in mixing.emit_rows(docs).collect():
        taken[r["source"], r["text"]] = taken.get((r["source"], r["text"]), 0) + 1
    assert sum(taken.values()) == sum(r["copies"] for r in rows) and max(n for (s, _), n in taken.items() if s) <= 3
    assert sorted(map(str, rows)) == sorted(map(str, mixing.copies(docs).collect()))


# -- secrets --


def test_spans_and_links(spark):
    key, token = "AKIA" + "Q2" * 8, "Ab1/" * 10
    texts = [
        None, "", f"😀 password: 'abcdefg' AKIA12 {key}", "secret=token:abcdefgh", "0123456789abcdef01234567 deadbeef",
        f"id {key} then {token} host https://db.example.net/x", f"only {token} here", "login = bob", f"user: bobby password=hunter22 {'x' * 900} {token}",
    ]
    rows = {r["doc_id"]: r for r in secret_links.reported(table(spark, texts)).collect()}
    at = texts[2].index("password")
    assert rows[2]["spans"] == f"assign:{at}:{at + 18},access:{texts[2].index(key)}:{texts[2].index(key) + 20}"
    assert (rows[3]["n_assign"], rows[4]["n_hex"], rows[0]["spans"], rows[1]["spans"]) == (0, 1, "", "")
    kinds = lambda i: [x.split(":")[0] for x in rows[i]["spans"].split(",") if x]
    assert kinds(5) == ["access", "weak", "endpoint"] and kinds(6) == [] and kinds(7) == [] and kinds(8) == ["login", "assign"]
    assert rows[5]["base_sha256"] == hashlib.sha256(f"access:3:{3 + 20}".encode()).hexdigest()
    full = f"id {key} pw password=longenough host https://db.example.net/x"
    assert "endpoint" in secret_links.reported(table(spark, [full])).first()["spans"]
    assert secret_links.reported(table(spark, texts).limit(0)).count() == 0


def test_redaction(spark):
    key, token = "AKIA" + "Q2" * 8, "Ab1/" * 10
    docs = table(spark, [None, f"id {key} then {token}", f"only {token}", "token: abcdefgh, token: abc", "plain", "login=abc login=abcd password=longenough"])
    got = secret_links.redact_rows(docs)
    assert got.columns == docs.columns
    assert [r["text"] for r in got.orderBy("doc_id").collect()] == [None, "id [access] then [linked]", f"only {token}", "[assign], token: abc", "plain", "[linked] [linked] [assign]"]


def test_redaction_of_overlapping_spans(spark):
    key, token = "AKIA" + "Q2" * 8, "Ab1/" * 10
    texts = ["login: password=hunter22", f"{key} secret={token}.tail", f"😀 {key} {token} {'x ' * 300}{token}", "é user=bob user=bobby password=hunter22", f"{key}{'0' * 24}abc", f"{key}\nsecret=abcdefgh"]
    got = secret_links.redact_rows(table(spark, texts))
    assert [r["text"] for r in got.orderBy("doc_id").collect()] == ["[assign]", "[access] [assign]", f"😀 [access] [linked] {'x ' * 300}[linked]", "é [linked] [linked] [assign]", "[access]", "[access]\n[assign]"]


# -- nearest neighbours --


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1200, 24)) + 3 * rng.standard_normal((6, 24))[rng.integers(0, 6, 1200)]
    x *= rng.uniform(0.2, 3, (1200, 1))
    x[300:360] = x[300]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = adaptive_ann.nearest(rows).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 1200, 20))
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        scores = adaptive_ann.exact_scores(np.repeat(x[q : q + 1], 1200, 0), x)
        best = [i for i in np.lexsort((np.arange(1200), -scores)) if i != q][:20]
        hits += len(set(best) & {r["vec_id"] for r in found})
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(r["score"] == scores[r["vec_id"]] for r in found)
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
    assert hits / (20 * len(by)) >= 0.9


def test_ann_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [0.5, None]), (5, [1.0, 1.0]), (6, [1.0]), (None, [2.0, 2.0]), (20, [0.0, 1.0]), (7, [float("inf"), 0.0]), (0, [1.0, 0.0])]
    got = adaptive_ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 5, 1.0), (0, 2, 20, 0.0), (20, 1, 5, 1.0), (20, 2, 0, 0.0), (20, 3, 0, 0.0)]
    assert adaptive_ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


@pytest.mark.parametrize("n", [17, 21, 24, 40])
def test_ann_ranks_are_whole_on_small_tables(spark, n):
    rng = np.random.default_rng(n)
    # Far groups, the last one small: the lists near a query of it hold few vectors.
    x = rng.standard_normal((n, 64)) + 20 * np.repeat(rng.standard_normal((4, 64)), [n - 9, 3, 3, 3], axis=0)
    rows = spark.createDataFrame([(20 * i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())], "vec_id bigint, embedding array<double>")
    by = {}
    for r in adaptive_ann.nearest(rows).collect():
        by.setdefault(r["query_id"], []).append(r["rank"])
    assert set(by) == {20 * i for i in range(n)}
    assert all(sorted(ranks) == list(range(1, min(20, n - (q == 0)) + 1)) for q, ranks in by.items())


def test_ann_searches_each_dimension(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0, 9.0]), (40, [1.0, 1.0, 1.0])]
    got = adaptive_ann.nearest(spark.createDataFrame(rows[:4], "vec_id bigint, embedding array<double>"))
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    got = adaptive_ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert sorted((r["query_id"], r["vec_id"]) for r in got.collect()) == [(0, 1), (0, 20), (20, 0), (20, 1), (40, 2)]


@pytest.mark.parametrize("n", [1, 2, 5, 16, 20, 25])
def test_ann_few_vectors_equal_brute_force(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 8))
    rows = spark.createDataFrame([(20 * i, v.tolist(), "x", 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, list string, rank int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in adaptive_ann.nearest(rows).collect())
    best = {i: [j for j in np.argsort(-(x @ x[i]), kind="stable") if j != i][:20] for i in range(n)}
    missed = len({(20 * i, 20 * int(j)) for i in best for j in best[i]} - {(q, v) for q, _, v in got})
    assert [(q, r) for q, r, _ in got] == [(20 * i, r) for i in range(n) for r in range(1, min(20, n - 1) + 1)]
    assert missed <= (0 if n <= 21 else 0.1 * 20 * n)


def test_ann_recall_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in adaptive_ann.usable(table, "vec_id", "embedding").withColumnRenamed("v", "embedding").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = {}
    for r in adaptive_ann.nearest(table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in ids[ids % 20 == 0]:
        scores = x @ x[ids == q][0]
        scores[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.argsort(-scores, kind="stable")[:20]].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_ann_scan_with_thresholds_loses_nothing():
    rng = np.random.default_rng(6)
    x, q = rng.standard_normal((3000, 40)) * rng.uniform(0.1, 5, (3000, 1)), rng.standard_normal((30, 40))
    longest = float((x * x).sum(axis=1).max())
    scores = q @ x.T
    least = np.sort(scores, axis=1)[:, -20]
    found = adaptive_ann.scan(np.arange(30), q, np.arange(3000) + 100, x, adaptive_ann.rotation(41), longest, 20, least - 1e-9, epsilon=1e9)
    assert all(set(found[1][found[0] == i] - 100) == set(np.argsort(-scores[i])[:20]) for i in range(30))


def test_ann_scan_gives_k_rows():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((20, 512))
    ids = np.arange(20) + 100
    found = adaptive_ann.scan(np.arange(50), rng.standard_normal((50, 512)), ids, x, adaptive_ann.rotation(513), float((x * x).sum(axis=1).max()), 20)
    assert np.bincount(found[0]).tolist() == [20] * 50


# -- SentencePiece --


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path(piece_codec.MODEL)


def test_pieces_equal_the_library(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    v = piece_codec.load(model)
    rng = random.Random(7)
    texts = ["", " ", "   ", "\n", "a\x00b", "\r\n x\r", "▁▁x ▁", "日本語", "🤦🏼‍♂️", "a" * 700, " " * 40, "</s><unk>", "1234567890", "});\r\n"]
    texts += ["".join(rng.choice('ab c\n1.,▁é日"({});\r\t') for _ in range(rng.randint(1, 60))) for _ in range(500)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 1000), rng.randint(0x3000, 0x9FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(40)) for _ in range(200)]
    ids, counts = piece_codec.encode_batch(v, [t.encode() for t in texts])
    at = np.concatenate([[0], np.cumsum(counts)])
    for t, a, b in zip(texts, at[:-1], at[1:]):
        assert ids[a:b].tolist() == sp.encode(t), t
        assert piece_codec.decode(v, ids[a:b].tolist()).decode() == t.replace("▁", " ")


def test_edge_order_beyond_8_mib():
    for depth in (9, 1 << 23, (1 << 24) + 5):
        d = np.array([depth, depth, 3, depth - 1, depth], np.int64)
        assert piece_codec._edge_order(d, d + 7, np.array([2, 16, 1, 1, 3], np.int64)).tolist() == [2, 3, 1, 4, 0]


def test_codec_table(spark):
    docs = table(spark, [None, "", "Hello  world\n", "x" * 5000, "same", "same", "a▁b"])
    rows = piece_codec.coded(docs).withColumn("back", piece_codec.decoded(F.col("pieces"))).orderBy("doc_id").collect()
    assert [r["back"] for r in rows] == ["", "", "Hello  world\n", "x" * 5000, "same", "same", "a b"]
    assert all(r["exact"] == (r["doc_id"] != 6) and r["n_pieces"] == len(r["pieces"]) for r in rows)
    assert piece_codec.coded(docs.limit(0)).count() == 0
