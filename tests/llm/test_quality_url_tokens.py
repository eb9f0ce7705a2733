import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronogeo.llm import quality_knn, quality_rules, token_counts, url_rules

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, m string, row string, host string, row_number int"
PATH = "byte_bpe_50k.json"


def documents(spark, texts, source="s"):
    return spark.createDataFrame([(None if t == "noid" else i, None if t == "null" else t, "en", None if i % 5 == 4 else source, 1, "x", "y", "z", 1) for i, t in enumerate(texts)], DOCS)


GOOD = " ".join(f"word{i}" for i in range(40))


def slow_measure(t):
    words = t.encode().split()
    covered = set()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in t.encode().split(b"\n") if x.split()]
    return len(words), sum(len(w.decode()) for w in words), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force():
    rng = random.Random(1)
    texts = ["", " \n ", "a b c d e", "a a a a a a", "ä# b\n\nä# b\n", "x\x0by\x1cz\u00a0w"] + ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    for t in texts:
        assert quality_rules.measure(t.encode()) == slow_measure(t), t


def test_hosts_reject_and_keep(spark):
    bad = [("b " * 30, "bad")] * 40 + [(GOOD, "bad")] * 2 + [(GOOD, "good")] * 60 + [("b " * 30, "good")] + [(GOOD, None)] * 3 + [(None, "small")]
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(bad)], "doc_id bigint, text string, source string")
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert len(rows) == len(bad)
    assert not rows[41]["kept"] and not rows[41]["base_failed"]  # its host is rejected
    assert rows[42]["kept"] and rows[103]["kept"] and not rows[106]["kept"]
    kept = quality_rules.keep_rows(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows.values())


def test_quality_empty_and_clashing(spark):
    docs = documents(spark, ["null", "", GOOD, GOOD, "noid"])
    assert quality_rules.judge(docs).count() == 5
    assert quality_rules.keep_rows(docs).columns == docs.columns
    assert quality_rules.judge(docs.limit(0)).count() == 0 and quality_rules.keep_rows(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tk():
    import public_tokenizers

    return token_counts.tokenizer(public_tokenizers.path(PATH))


def test_long_texts_splice_exactly(tk):
    rng = random.Random(2)
    words = ["a", "the", "Überraschung", "don't", "12345", "!!", "<|endoftext|>", "日本語", "x" * 90]
    gaps = [" ", "  ", "\n", "\n\n  ", "\u00a0", "\t"]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(400)) for _ in range(12)] + ["a" * 3000, " " * 3000, "\u00a0" * 2000, "é" * 2500 + " x", "<|endoftext|>" * 200]
    for t in texts:
        want = len(tk.encode(t, add_special_tokens=False))
        for chunk, overlap in ((50, 4), (300, 40), (1000, 100)):
            assert token_counts.count_long(tk, t, chunk, overlap) == want
        assert token_counts.count_short(tk, [t]) == [want]


def test_token_table(spark, tk):
    docs = documents(spark, ["null", "", "Hello  world", GOOD * 40, "<|endoftext|> x", GOOD * 40])
    rows = token_counts.counted(docs, chunk=500, overlap=50).orderBy("doc_id").collect()
    for r, t in zip(rows, ["", "", "Hello  world", GOOD * 40, "<|endoftext|> x", GOOD * 40]):
        n = len(tk.encode(t, add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)
    assert token_counts.counted(docs.limit(0)).count() == 0


def test_url_rules(spark):
    urls = ["http://a.org/x", "https://EXAMPLE.org/es/1", "https://m.example.org/en/17", "https://m.example.org/en/27", "http://b.com/de/1?x", "http://b.com/fr/", "http://b.com", "http://notexample.org/es/", "http://free-bets.example.net/a", "nothing", None, "x://casino.net/a#b", "http://y.net/wp-login.php", "http://z.net/a://b", "http:///p", "http://y.net/wp-login.php", "http://my-bet.net/", "http://bet.net/", "http://abet.net/", "http://y.net/wp-login.php\n"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judged(pages).collect()}
    assert rows[0] == ("a.org", "/x", "org/", "allow")
    assert rows[1] == ("example.org", "/es/1", "example.org/es/", "block")
    assert rows[2][2:] == ("example.org/en/1", "block") and rows[3][2:] == ("org/", "allow")
    assert rows[4] == ("b.com", "/de/1", "com/de/", "block") and rows[5][2:] == ("com/fr/", "allow")
    assert rows[6] == ("b.com", "", None, "allow") and rows[7][2:] == ("org/", "allow")
    assert rows[8][2:] == (None, "block") and rows[9] == ("", "", None, "allow") and rows[10] == ("", "", None, "allow")
    assert rows[11] == ("casino.net", "/a", None, "block") and rows[12][3] == "block" and rows[13][:2] == ("z.net", "/a://b") and rows[14][:2] == ("", "/p")
    assert [rows[i][3] for i in (16, 17, 18, 19)] == ["block", "block", "allow", "allow"]
    assert url_rules.judged(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_rules.judged(pages, ()).collect()} == {"allow"}


def test_tokens_are_derived_from_patterns():
    want = {
        r"(?:^|[.-])bets\.": ("bets",), r"/wp-login\.php\Z": ("wp", "login", "php"), r"/wp-login\.php": ("wp", "login"), r"^(?:[^/]*\.)?a1\.org/x/y": ("a1", "org", "x"),
        r"bets\.": (), r"(?i)/bets/": (), r"/(?:a|b)-c/": ("c",), r"/a?b/": (), r"/(?:ab-)+cd/": ("cd",), r"/(?:ab)*cd/": (), r"\bfoo\b": ("foo",), r"[^a-zA-Z0-9]foo[/?]x": ("foo",),
        r"[^a-z]foo/": (), r"/x(?=y)/": (), r"/é-b/": ("b",), r".": (), r"/(?:ab/)?cd/": ("cd",), r"(?:.*/)?cd/": (), r"^(?:.*/)?cd/": ("cd",), r"/A-b/": ("a", "b"),
    }
    assert {p: url_rules.required_tokens(p) for p in want} == want


def test_derived_tokens_are_in_every_match():
    rng = random.Random(12)
    atoms = ["a", "b1", "-", r"\.", "/", "[.-]", "[a-z]", "(?:^|[.-])", "(?:ab-)?", "(?:a|b/)", "^", r"\Z", ".*", "(?:/x)+", r"\b", "(?:a-|b-)", "[^/]*"]
    subjects = ["".join(rng.choice(["a", "b1", "-", ".", "/", "ab", "x", "B", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    hits = 0
    for _ in range(6000):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 6)))
        needed, compiled = set(url_rules.required_tokens(pattern)), re.compile(pattern)
        for s in subjects:
            if needed and compiled.search(s):
                hits += 1
                assert needed <= set(url_rules.tokens(s)), (pattern, s)
    assert hits > 100


def test_a_table_of_rules_of_any_size(spark, monkeypatch):
    rng = random.Random(5)
    rules = [url_rules.site_rule("block" if i % 3 else "allow", f"h{i}.net/") for i in range(100_001)]
    rules += [url_rules.site_rule("allow", "h7.net/x/"), url_rules.site_rule("block", "net/"), *url_rules.PATTERN_RULES, url_rules.pattern_rule("block", "any x", "x+y"), url_rules.pattern_rule("allow", "any z", "zz")]
    urls = [None, "nothing", "http://h7.net/x/1", "http://h7.net/y", "http://a.h100000.net/", "http://other.net/xy", "http://b.org/xxy", "http://b.org/xyzz", "http://b.org/zz", "http://bet.org/", "http://b.org/wp-login.php"]
    urls += [f"http://{rng.choice(['', 'm.'])}h{rng.randrange(200_000)}.{rng.choice(['net', 'org'])}/{rng.choice(['x/', 'wp-login.php', 'xy'])}" for _ in range(150)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("token", F.lit("clash")).withColumn("place", F.lit(1))
    index = url_rules.RuleIndex(tuple(rules), {})
    want = {r["page_id"]: index.judge(r["host"], r["path"]) for r in pages.select("page_id", *[c.alias(n) for c, n in zip(url_rules.url_parts(F.col("url")), ("host", "path"))]).collect()}
    got = {r["page_id"]: (r["rule"], r["pattern"], r["verdict"]) for r in url_rules.judged(pages, tuple(rules)).collect()}
    assert got == want
    monkeypatch.setattr(url_rules, "MAX_RULES", 1)  # the rules without a token in several blocks
    few = (*rules[-4:], *url_rules.SITE_RULES, url_rules.site_rule("allow", "net/"))
    index = url_rules.RuleIndex(few, {})
    want = {r["page_id"]: index.judge(r["host"], r["path"]) for r in pages.select("page_id", *[c.alias(n) for c, n in zip(url_rules.url_parts(F.col("url")), ("host", "path"))]).collect()}
    assert {r["page_id"]: (r["rule"], r["pattern"], r["verdict"]) for r in url_rules.judged(pages, few).collect()} == want
    assert url_rules.judged(pages.limit(0), few).count() == 0


def test_index_loses_no_rule():
    rng = random.Random(3)
    rules = url_rules.SITE_RULES + url_rules.PATTERN_RULES
    index = url_rules.RuleIndex(rules, {"org": 5, "com": 9})
    parts = ["org", "com", "example", "bets", "casino", "wp", "login", "php", "cheap", "pills", "xxx", "en", "es", "de", "fr", "1", "-", ".", "/"]
    for _ in range(4000):
        host = "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))).replace("/", ".")
        path = "/" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
        found = set(index.always)
        for t in set(url_rules.tokens(host)) | set(url_rules.tokens(path)):
            found |= set(index.by_token.get(t, ()))
        assert all(i in found for i in range(len(rules)) if index.fits(i, host + path))


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_knn.scored(docs, labels).join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.97


def test_votes_match_brute_force():
    rng = random.Random(9)
    words = [f"{rng.choice('abcdefgh')}{rng.choice('xyz')}{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    texts += texts[:20]  # ties
    labels = np.array([float(rng.random() < 0.5) for _ in texts])
    model = quality_knn.fit(np.stack([quality_knn.terms(t.encode()) for t in texts]), labels, rank=8)
    asked = ["", *texts[5:40:7], *(" ".join(rng.choice(words) for _ in range(12)) for _ in range(30))]
    got = quality_knn.vote(model, np.stack([quality_knn.terms(t.encode()) for t in asked]), 7)
    for t, score in zip(asked, got):
        place = quality_knn.terms(t.encode()).astype(float) @ model["axes"].astype(float)
        size = sum(x * x for x in place) ** 0.5
        near = [sum(a * float(b) for a, b in zip(place, v)) / size if size else 0.0 for v in model["vectors"]]
        last = sorted(near)[-7]
        votes = [(max(n, 0) ** 4, label) for n, label in zip(near, labels) if n >= last - 1e-6]
        want = sum(w * label for w, label in votes) / sum(w for w, _ in votes) if any(w for w, _ in votes) else labels.mean()
        assert abs(score - want) < 1e-4, t


def test_classifier_edges(spark):
    docs = documents(spark, ["null", "", GOOD, "noid"] + [GOOD + f" x{i}" for i in range(9)] + ["*** " * 20] * 9)
    labels = spark.createDataFrame([(i, 1) for i in range(4, 13)] + [(i, 0) for i in range(13, 22)] + [(None, 1), (2, None), (4, 1)], "doc_id bigint, quality int")
    rows = quality_knn.scored(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["predicted"] for r in rows}
    assert by[2] == 1 and by[13] == 0
    assert {r["score"] for r in quality_knn.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_knn.scored(docs.limit(0), labels).count() == 0
