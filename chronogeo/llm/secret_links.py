"""Secret scans with multipart credential linking. DataFrame functions only.

Strong spans (assign, access, hex) are reported wherever they stand. Weak
candidates (a 40-character token, a login name, an endpoint) are reported
only if complementary parts co-occur: candidates and parts are joined as
intervals within a scope of ``SCOPE`` code points in the same document.
A weak token needs an identifier (access or login) in its scope; a login
needs a secret (assign, hex or weak token); an endpoint needs both.

Positions are code points, end exclusive. Spark gives no match positions, so a
text is split by the pattern: pieces and matches alternate, and their lengths
add up to positions. The sums are made by doubling, in n log n steps for n
matches of one text.

Defined results: a null text counts as empty and has no spans; repeated rows
each get their spans; parts are keyed by (doc_id, hash of the text), so rows
that repeat a doc_id with another text are told apart; an empty table gives an
empty result; columns other than the id and the text are ignored by
``reported`` and kept by ``redact_rows``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogeo.session import durable

SCOPE = 200
#: Texts are rebuilt from blocks of so many code points.
BLOCK = 512
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> pattern, group whose length counts, least length, greatest length; in the order of reports.
KINDS = {
    "assign": (ASSIGN, 2, 6, None),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, None),
    "hex": (r"[0-9a-f]{24,}", 0, 24, None),
    "weak": (r"[A-Za-z0-9+/]{40,}", 0, 40, 40),
    "login": (r"""(?i)(username|login|user)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3, None),
    "endpoint": (r"(?i)(https?|postgres|mysql|mongodb|amqp|redis)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", 0, 10, None),
}
STRONG = ("assign", "access", "hex")
WEAK = ("weak", "login", "endpoint")
IDENTIFIERS, SECRETS = ("access", "login"), ("assign", "hex", "weak")
ORDER = {k: i for i, k in enumerate(KINDS)}
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums, maxima and the like of an array, by doubling: no array grows element by element."""
    reach = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    add = lambda acc, step: F.transform(acc, lambda x, i: F.when(i >= step, join(x, F.get(acc, i - step))).otherwise(x))
    return F.aggregate(reach, values, add)


def _placed(pieces: Column, sizes: Column) -> Column:
    """Array of (start, end) of matches, of the pieces of text before them and their own sizes."""
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(sizes)), sizes, lambda p, n: F.length(p) + n)
    return F.zip_with(running(steps, lambda x, y: x + y), sizes, lambda end, n: F.struct((end - n).alias("start"), end.alias("end")))


def spans_of(text: Column, kind: str) -> Column:
    """Array of (start, kind, end, value) of a kind's matches in a text."""
    pattern, group, least, most = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [_placed(F.split(text, pattern, -1), F.transform(whole, F.length)).alias("at"), whole.alias("whole")]
    if group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    size = lambda x: F.length(x["part" if group else "whole"])
    rows = F.filter(F.arrays_zip(*parts), lambda x: size(x) >= least if most is None else (size(x) >= least) & (size(x) <= most))
    value = lambda x: x["whole"] if kind in WEAK else F.lit(None).cast("string")
    found = F.transform(rows, lambda x: F.struct(x["at"]["start"].alias("start"), F.lit(ORDER[kind]).alias("kind"), x["at"]["end"].alias("end"), value(x).alias("value")).cast(SPAN))
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def scanned(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, hash of the text, strong and weak spans; the only pass over the texts."""
    t = F.col(text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(t).alias("h"),
        *[spans_of(t, k).alias(k) for k in KINDS],
    )
    return rows.select("doc_id", "h", *[F.size(k).cast("long").alias(f"n_{k}") for k in STRONG], F.concat(*STRONG).alias("strong"), F.concat(*WEAK).alias("weak"))


def linked(scans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, h and the weak spans that have complementary parts in their scope."""
    rows = scans.filter(F.size("weak") > 0).filter(F.size("weak") + F.size("strong") > 1).select("doc_id", "h", "strong", "weak").dropDuplicates(["doc_id", "h"])
    cell = lambda c: F.floor(c / scope)
    parts = rows.select("doc_id", "h", F.explode(F.concat("strong", "weak")).alias("s")).filter(F.col("s.kind") != ORDER["endpoint"])
    parts = parts.select(F.col("doc_id").alias("p_id"), F.col("h").alias("p_h"), F.col("s.kind").alias("p_kind"), F.col("s.start").alias("p_start"), F.col("s.end").alias("p_end"), F.explode(F.sequence(cell(F.col("s.start")), cell(F.col("s.end")))).alias("p_cell"))
    weak = rows.select("doc_id", "h", F.explode("weak").alias("s"))
    weak = weak.select("doc_id", "h", "s", F.explode(F.sequence(cell(F.col("s.start") - scope), cell(F.col("s.end") + scope))).alias("cell"))
    near = weak.join(
        parts,
        F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("h") == F.col("p_h")) & (F.col("cell") == F.col("p_cell"))
        & (F.col("p_start") <= F.col("s.end") + scope) & (F.col("p_end") >= F.col("s.start") - scope)
        & ~((F.col("p_start") == F.col("s.start")) & (F.col("p_end") == F.col("s.end")) & (F.col("p_kind") == F.col("s.kind"))),
    )
    has = lambda kinds: F.max(F.col("p_kind").isin(*[ORDER[k] for k in kinds]))
    seen = near.groupBy("doc_id", "h", "s").agg(has(IDENTIFIERS).alias("identifier"), has(SECRETS).alias("secret"))
    kind = F.col("s.kind")
    told = seen.filter(
        ((kind == ORDER["weak"]) & F.col("identifier"))
        | ((kind == ORDER["login"]) & F.col("secret"))
        | ((kind == ORDER["endpoint"]) & F.col("identifier") & F.col("secret"))
    )
    return told.groupBy(F.col("doc_id").alias("l_id"), F.col("h").alias("l_h")).agg(F.collect_list("s").alias("linked"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind as listed, then end."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def found(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, strong (array), linked (array), one row per input row."""
    scans = durable(scanned(docs, text, doc_id))
    links = linked(scans, scope)
    rows = scans.join(links, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("h") == F.col("l_h")), "left")
    return rows.select("doc_id", *[f"n_{k}" for k in STRONG], "strong", F.coalesce("linked", F.array().cast(f"array<{SPAN}>")).alias("linked"))


def reported(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return found(docs, **options).select("doc_id", *[f"n_{k}" for k in STRONG], F.sha2(spans_text(F.col("strong")), 256).alias("base_sha256"), spans_text(F.concat("strong", "linked")).alias("spans"))


def _copies(text: Column, value: Column) -> Column:
    """Spans of all places where a linked value stands in a text."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), value, F.lit("\\E")), -1)
    # No value follows the last piece.
    sizes = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda x: F.length(value))
    return F.transform(_placed(pieces, sizes), lambda x: F.struct(x["start"].alias("start"), F.lit(ORDER["weak"]).alias("kind"), x["end"].alias("end"), F.lit(None).cast("string").alias("value")).cast(SPAN))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text from start to end, of blocks of ``BLOCK`` code points: no cut counts from the text's beginning."""
    first = (start / BLOCK).cast("int")
    own = F.slice(blocks, first + 1, ((end - 1) / BLOCK).cast("int") - first + 1)
    return F.when(end > start, F.substring(F.array_join(own, ""), start - first * BLOCK + 1, end - start)).otherwise(F.lit(""))


def _rebuilt(text: Column, spans: Column) -> Column:
    """The text with its spans replaced, those that overlap by one mark (a strong kind's, if one is among them).

    Sorted spans open a region where none before reaches; regions are numbered,
    and the greatest end and the least kind of each are running maxima.
    """
    last = len(KINDS)
    ranked = F.array_sort(spans)
    reach = F.zip_with(ranked, running(F.transform(ranked, lambda s: s["end"]), F.greatest), lambda s, e: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), e.alias("end")))

    def regions(spans: Column) -> Column:
        opens = F.transform(spans, lambda s, i: F.when(s["start"] < F.get(spans, i - 1)["end"], 0).otherwise(1))
        number = running(opens, lambda x, y: x + y)
        least = running(F.zip_with(number, spans, lambda n, s: n * (last + 1) + last - s["kind"]), F.greatest)
        closes = F.transform(spans, lambda s, i: F.when(F.get(spans, i + 1)["start"] < s["end"], 0).otherwise(1))
        every = F.arrays_zip(spans.alias("span"), opens.alias("opens"), closes.alias("closes"), least.alias("least"))
        heads = F.transform(F.filter(every, lambda x: x["opens"] == 1), lambda x: x["span"]["start"])
        tails = F.transform(F.filter(every, lambda x: x["closes"] == 1), lambda x: F.struct(x["span"]["end"].alias("end"), (last - F.pmod(x["least"], F.lit(last + 1))).alias("kind")))
        return F.zip_with(heads, tails, lambda start, tail: F.struct(start.alias("start"), tail["end"].alias("end"), tail["kind"].alias("kind")))

    marks = F.array(*[F.lit(f"[{k}]" if k in STRONG else "[linked]") for k in KINDS])

    def pieces(found: Column, blocks: Column) -> Column:
        before = lambda i: F.coalesce(F.get(found, i - 1)["end"], F.lit(0))
        cut = F.transform(found, lambda x, i: F.concat(_cut(blocks, before(i), x["start"]), F.get(marks, x["kind"])))
        return F.concat(F.array_join(cut, ""), _cut(blocks, before(F.size(found)), F.length(text)))

    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  a value that is computed once
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    whole = let(reach, lambda r: let(regions(r), lambda found: let(blocks, lambda b: pieces(found, b))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact_rows(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """The input's rows with every reported span replaced in the text; other columns as they are.

    All spans, and all other places where a linked value stands, are found in
    the text as it came; overlapping ones are replaced as one.
    Only rows that hold a weak candidate meet the links in a join; all others
    are changed where they are read.
    """
    names = docs.columns
    t = F.col(f"`{text}`")
    scans = durable(scanned(docs.filter(reduce(lambda a, b: a | b, [t.rlike(KINDS[k][0]) for k in WEAK])), text, doc_id))
    links = linked(scans, scope)
    none = F.array().cast(f"array<{SPAN}>")
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), t.alias("t"), F.col(f"`{doc_id}`").alias("id"), F.coalesce(reduce(lambda a, b: a | b, [t.rlike(KINDS[k][0]) for k in WEAK]), F.lit(False)).alias("maybe"))
    some = wide.filter("maybe").withColumn("h", F.xxhash64("t")).join(links, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("h") == F.col("l_h")), "left")
    values = F.array_distinct(F.transform("linked", lambda s: s["value"]))
    more = F.concat(F.col("linked"), F.flatten(F.transform(values, lambda v: _copies(F.col("t"), v))))
    some = some.select("row", "t", F.coalesce(more, none).alias("more"))
    rows = wide.filter(~F.col("maybe")).select("row", "t", none.alias("more")).unionByName(some)
    rows = rows.select("row", _rebuilt(F.col("t"), F.concat(*[spans_of(F.col("t"), k) for k in STRONG], F.col("more"))).alias("t"))
    return rows.select(*[F.col("t").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names])
