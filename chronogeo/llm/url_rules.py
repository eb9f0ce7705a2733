"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression on host + path. The literal tokens (runs of a-z,
0-9) that every match must hold as whole tokens are derived from the expression.
Each rule is filed under the one of its tokens that is rarest in the judged
URLs; the tokens of a URL fetch candidate rules, and only those run their
expressions. Rules without a literal token run on every URL.

Up to ``MAX_RULES`` rules are an index that goes to each task. A longer table,
or one given as a DataFrame, stays a table: rules and URLs meet in a join by
token, and only its rules without a token go to tasks, MAX_RULES at a time.

Site rules (``host/path prefix``) decide first, the longest that fits (of equal
ones the first); where none fits, the first pattern rule that matches decides,
and else the URL is allowed.

Defined results: a null URL, or one without ``://``, has empty host and path,
which no site rule fits; repeated rows are each judged; an empty table gives
an empty result, and without rules every URL is allowed; columns other than
the id and the URL are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogeo.session import durable, ship_package

#: So many rules at most go to each task.
MAX_RULES = 100_000
RULES_DDL = "nth long, name string, verdict string, pattern string, site boolean"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    site: bool


def tokens(text: str) -> list[str]:
    return [x.decode() for x in re.findall(rb"[a-z0-9]+", text.encode("utf-8", "surrogatepass").lower())]


def _is_separator(kind, value) -> bool:
    """Whether a part of a pattern always takes a character that is in no token, or stands at an end of the URL."""
    if kind is op.LITERAL:
        return not (chr(value).isascii() and chr(value).isalnum())
    if kind is op.AT:
        return value in (op.AT_BEGINNING, op.AT_BEGINNING_STRING, op.AT_END, op.AT_END_STRING, op.AT_BOUNDARY)
    if kind is op.IN:
        taken, negated = set(), False
        for k, v in value:
            if k is op.NEGATE:
                negated = True
            elif k is op.LITERAL:
                taken.add(v)
            elif k is op.RANGE:
                taken |= set(range(v[0], min(v[1], 127) + 1))
            else:
                return False
        letters = {i for i in range(128) if chr(i).isalnum()}
        return not (letters - taken if negated else letters & taken)
    if kind is op.BRANCH:
        return all(len(x) and all(_is_separator(*y) for y in x) for x in value[1])
    if kind is op.SUBPATTERN:
        return bool(len(value[3])) and all(_is_separator(*y) for y in value[3])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        return value[0] > 0 and bool(len(value[2])) and all(_is_separator(*y) for y in value[2])
    return False


def _flat(parts) -> list:
    """Parts of a pattern, those of plain groups in a row with the others."""
    out = []
    for kind, value in parts:
        plain = kind is op.SUBPATTERN and not value[1] and not value[2]
        out += _flat(value[3]) if plain and not _is_separator(kind, value) else [(kind, value)]
    return out


def _walk(parts, bounded: bool, found: list[str]) -> bool:
    """Adds whole tokens that parts must hold; whether no token can go on after them. bounded: the same, before them."""
    run = None
    for kind, value in _flat(parts):
        if kind is op.LITERAL and not _is_separator(kind, value):
            run = (run if run is not None else "" if bounded else "?") + chr(value).lower()
            bounded = False
            continue
        separator = _is_separator(kind, value)
        if run and separator and not run.startswith("?"):
            found.append(run)
        run = None
        if separator:
            bounded = True
        elif kind is op.BRANCH:
            bounded = all([_walk(x, bounded, []) for x in value[1]])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = value
            bounded = _walk(inner, bounded and most == 1, []) and (least > 0 or bounded)
        else:
            bounded = False
    return bounded


def required_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens that every match of a pattern holds whole; not all of them where the pattern is intricate."""
    parsed, found = _parser.parse(pattern), []
    if not parsed.state.flags & re.IGNORECASE:  # ignoring case, some letters stand for others than ASCII ones
        _walk(parsed, False, found)
    return tuple(dict.fromkeys(found))


def site_rule(verdict: str, site: str) -> Rule:
    """A rule on a host, its subdomains and a path prefix, such as ``net/en/``."""
    host, _, path = site.partition("/")
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}"
    return Rule(site, verdict, pattern, required_tokens(pattern), True)


def pattern_rule(verdict: str, name: str, pattern: str) -> Rule:
    return Rule(name, verdict, pattern, required_tokens(pattern), False)


SITE_RULES = (site_rule("allow", "org/"), site_rule("block", "example.org/es/"), site_rule("block", "example.org/en/1"), site_rule("allow", "com/fr/"), site_rule("block", "com/de/"))
PATTERN_RULES = (
    pattern_rule("block", "bets", r"(?:^|[.-])bets\."),
    pattern_rule("block", "bet", r"(?:^|[.-])bet\."),
    pattern_rule("block", "casino", r"^[^/]*(?:^|[.-])casino[.-]"),
    pattern_rule("block", "pills", r"(?:^|[./-])cheap-pills(?:[./-]|\Z)"),
    pattern_rule("block", "adult", r"^[^/]*(?:^|[.-])xxx[.-]"),
    pattern_rule("block", "login pages", r"/wp-login\.php\Z"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER), F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def token_column() -> Column:
    """Distinct tokens of host and path."""
    return F.array_distinct(F.split(F.translate(F.concat("host", F.lit("/"), "path"), UPPER, LOWER), "[^a-z0-9]+"))


def token_counts(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """In how many (host, path) rows each literal token of the rules occurs."""
    wanted = sorted({t for r in rules for t in r.literals})
    if not wanted:
        return {}
    spark = urls.sparkSession
    asked = spark.createDataFrame([(t,) for t in wanted], "token string")
    rows = urls.select(F.explode(token_column()).alias("token")).join(F.broadcast(asked), "token").groupBy("token").count()
    return {r["token"]: r["count"] for r in rows.collect()}


class RuleIndex:
    """Candidate rules by token; judges one URL at a time."""

    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.rules, self.by_token, self.always = rules, {}, []
        self.size = {i: len(r.name) for i, r in enumerate(rules) if r.site}
        for i, r in enumerate(rules):
            if r.literals:
                self.by_token.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), t)), []).append(i)
            else:
                self.always.append(i)
        self.compiled = {}

    def fits(self, i: int, subject: str) -> bool:
        if i not in self.compiled:
            self.compiled[i] = re.compile(self.rules[i].pattern)
        return self.compiled[i].search(subject) is not None

    def judge(self, host: str, path: str) -> tuple[str | None, str | None, str]:
        """Site rule, pattern rule, verdict."""
        subject, found = host + path, list(self.always)
        for t in set(tokens(host)) | set(tokens(path)):
            found += self.by_token.get(t, ())
        sites = [i for i in found if self.rules[i].site]
        for i in sorted(sites, key=lambda i: (-self.size[i], i)):
            if self.fits(i, subject):
                return self.rules[i].name, None, self.rules[i].verdict
        for i in sorted(i for i in found if not self.rules[i].site):
            if self.fits(i, subject):
                return None, self.rules[i].name, self.rules[i].verdict
        return None, None, "allow"


def _verdicts(index: RuleIndex) -> Column:
    """Struct of rule, pattern and verdict by an index that goes to each task."""

    def udf(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        rows = [index.judge(h or "", p or "") for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
        names = ("rule", "pattern", "verdict")
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=names)

    return F.arrow_udf(udf, "struct<rule:string,pattern:string,verdict:string>")("host", "path")


def _fits(subject: Column, pattern: Column) -> Column:
    def udf(subjects: pa.Array, patterns: pa.Array) -> pa.Array:
        compiled = {p: re.compile(p) for p in set(patterns.to_pylist())}
        return pa.array([compiled[p].search(s) is not None for s, p in zip(subjects.to_pylist(), patterns.to_pylist())], pa.bool_())

    return F.arrow_udf(udf, "boolean")(subject, pattern)


def _tokens_of(pattern: Column) -> Column:
    def udf(patterns: pa.Array) -> pa.Array:
        from chronogeo.llm.url_rules import required_tokens

        return pa.array([list(required_tokens(p)) for p in patterns.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(udf, "array<string>")(pattern)


def _judged_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls with rule, pattern and verdict, by a table of rules (RULES_DDL) of any size."""
    spark = urls.sparkSession
    distinct = durable(urls.select("host", "path").distinct())
    words = distinct.select("host", "path", F.explode(token_column()).alias("token"))
    known = durable(rules.withColumn("literals", _tokens_of(F.col("pattern"))))
    literals = known.select("nth", F.explode("literals").alias("token"))
    counts = words.join(literals.select("token").distinct(), "token").groupBy("token").count()
    filed = literals.join(counts, "token", "left").groupBy("nth").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("least"))
    filed = durable(known.drop("literals").join(filed.select("nth", F.col("least.token").alias("r_token")), "nth"))
    # The order of rules: sites before patterns, long sites first, then as they stand.
    place = F.struct(~F.col("site"), F.when(F.col("site"), -F.length("name")).otherwise(0), "nth", "name", "verdict").cast("struct<other:boolean,size:int,nth:bigint,name:string,verdict:string>")
    found = words.join(filed, F.col("token") == F.col("r_token")).filter(_fits(F.concat("host", "path"), F.col("pattern"))).select("host", "path", place.alias("place"))
    always = known.filter(F.size("literals") == 0).drop("literals")
    bounds, after = always.agg(F.count(F.lit(1)).alias("n")).first()["n"], None
    for _ in range(-(-bounds // MAX_RULES)):
        part = (always if after is None else always.filter(F.col("nth") > after)).orderBy("nth").limit(MAX_RULES).collect()
        after = part[-1]["nth"]
        index = RuleIndex(tuple(Rule(str(i), "", r["pattern"], (), r["site"]) for i, r in enumerate(part)), {})
        order = spark.createDataFrame([(str(i), r["nth"], r["name"], r["verdict"], r["site"]) for i, r in enumerate(part)], "i string, nth long, name string, verdict string, site boolean")
        lengths = [len(r["name"]) for r in part]
        index.size = dict(enumerate(lengths))
        hits = distinct.withColumn("v", _verdicts(index)).select("host", "path", F.coalesce("v.rule", "v.pattern").alias("i")).filter("i IS NOT NULL")
        found = found.unionByName(hits.join(F.broadcast(order), "i").select("host", "path", place.alias("place")))
    best = found.groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path")).agg(F.min("place").alias("place"))
    rows = urls.join(durable(best), (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    site = F.col("place.other") == F.lit(False)
    return rows.select("page_id", "host", "path", F.when(site, F.col("place.name")).alias("rule"), F.coalesce("place.verdict", F.lit("allow")).alias("verdict"), F.when(F.col("place.other"), F.col("place.name")).alias("pattern"))


def judged(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = SITE_RULES + PATTERN_RULES, *, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, pattern, verdict, one row per input row. A table of rules has the columns of RULES_DDL, nth unique."""
    spark = pages.sparkSession
    ship_package(spark)
    host, path = url_parts(F.col(f"`{url}`"))
    urls = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    if not isinstance(rules, DataFrame) and len(rules) <= MAX_RULES:
        index = RuleIndex(rules, token_counts(urls, rules))
        return urls.withColumn("v", _verdicts(index)).select("page_id", "host", "path", "v.rule", "v.verdict", "v.pattern")
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(i, r.name, r.verdict, r.pattern, r.site) for i, r in enumerate(rules)], RULES_DDL)
    return _judged_by_join(urls, rules)
