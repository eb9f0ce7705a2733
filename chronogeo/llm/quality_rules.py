"""Quality rules with host verdicts.

Every document gets base measurements. Failures are then added up by host,
the hosts' failure rates are shrunk towards the corpus with a beta prior that
is itself estimated from all hosts, and the host verdict goes back to the
documents: a document stays if its own rules pass and its host's shrunk rate
is not above ``max_host_rate``.

Defined results: a null text counts as empty (no words, base_failed); a null
host is a host of its own; repeated rows are each judged and each counted; an
empty table gives an empty result; other columns of the input are ignored by
``judge`` and kept by ``keep_rows``.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogeo.llm.words import word_parts
from chronogeo.session import durable, ship_package

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_NOT_STARTS = BLANKS + bytes(range(0x80, 0xC0))
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Rejected hosts are broadcast up to this count, and else joined by shuffle.
MAX_BROADCAST_HOSTS = 100_000


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that are found twice or more, of a text given as word numbers.

    Windows get numbers of their own, of ever more words: one number for each two that stand side by side. That is
    needed only where hashes of windows meet: equal windows have equal hashes.
    """

    def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]

    n = len(ids)
    if n <= window:
        return 0
    hashes = np.zeros(n - window + 1, np.uint64)
    for i in range(window):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + ids[i : n - window + 1 + i].astype(np.uint64)
    hashes.sort()
    if (hashes[1:] != hashes[:-1]).all():
        return 0
    named, width = ids.astype(np.int64), 1
    while width < window:
        step = min(width, window - width)
        named, width = paired(named[:-step], named[step:]), width + step
    starts = np.flatnonzero(np.bincount(named)[named] > 1)
    if not len(starts):
        return 0
    change = np.zeros(n + 1, np.int32)
    change[starts] += 1
    change[starts + window] -= 1
    return int(np.count_nonzero(np.cumsum(change)))


def measure(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    seen: dict[bytes, int] = {}
    ids = np.zeros(0, np.int32)
    for words in word_parts(data):
        seen.update(zip(set(words).difference(seen), count(len(seen))))
        ids = np.append(ids, np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
    chars = len(data.translate(None, _NOT_STARTS))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    return len(ids), chars, symbols, dup_lines, repeated_words(ids) if len(seen) < len(ids) else 0


_MEASURES = pa.struct([(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
MEASURES_DDL = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"


def _measure_arrow(texts: pa.Array) -> pa.Array:
    rows = [measure(x.as_py() or b"") for x in texts.cast(pa.binary())]
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_MEASURES))


def measured(text: Column) -> Column:
    """Struct of the base measurements of a text column."""

    def udf(texts: pa.Array) -> pa.Array:
        from chronogeo.llm.quality_rules import _measure_arrow

        return _measure_arrow(texts)

    return F.arrow_udf(udf, MEASURES_DDL)(text)


def base_failed(m: str = "m") -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (F.col(f"{m}.n_repeat_words") * 100 > F.col(f"{m}.n_words") * MAX_REPEAT_PERCENT)


def host_rates(judged: DataFrame) -> DataFrame:
    """host, n, failures and the shrunk rate (failures + a) / (n + a + b).

    a and b come from the moments of all hosts' rates: with corpus rate m and
    between-host correlation r (0 to 1), a + b = (1 - r) / r and a = m (a + b).
    Only one row of totals reaches the driver.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    totals = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("n").alias("n"), F.sum("failures").alias("f"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("failures").cast("double") * F.col("failures") / F.col("n")).alias("ffn")).first()
    h, n, f = totals["h"], float(totals["n"] or 0), float(totals["f"] or 0)
    mean = f / n if n else 0.0
    spread = mean * (1 - mean)
    room = n - (totals["nn"] or 0.0) / n - (h - 1) if n else 0.0
    r = ((totals["ffn"] - n * mean * mean) / spread - (h - 1)) / room if spread > 0 and room > 0 and h > 1 else 0.0
    r = min(max(r, 1e-6), 0.999999)
    strength = (1 - r) / r
    return hosts.withColumn("host_rate", (F.col("failures") + mean * strength) / (F.col("n") + strength))


def judge(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", host: str = "source", max_host_rate: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, host, measurements, base_failed, host_rate, kept."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), measured(F.col(text)).alias("m"))
    rows = durable(rows.select("doc_id", "host", "m.*", base_failed().alias("base_failed")))
    rates = host_rates(rows).select(F.col("host").alias("of_host"), "host_rate")
    return (
        rows.join(rates, F.col("host").eqNullSafe(F.col("of_host")), "left")
        .withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate))
        .drop("of_host")
    )


def keep_rows(docs: DataFrame, *, text: str = "text", host: str = "source", max_host_rate: float = 0.5) -> DataFrame:
    """The input's rows that stay, with the input's columns only.

    Measuring twice costs less than keeping all texts in a shuffle: the first
    pass gives the hosts' rates, the second judges each row where it is read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    names = docs.columns
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{host}`").alias("host"), measured(F.col(f"`{text}`")).alias("m"))
    rows = durable(wide.select("host", base_failed().alias("base_failed")))
    bad = durable(host_rates(rows).filter(F.col("host_rate") > max_host_rate).select(F.col("host").alias("bad_host")))
    kept, n_bad = wide.filter(~base_failed()), bad.count()
    if n_bad:
        bad = F.broadcast(bad) if n_bad <= MAX_BROADCAST_HOSTS else bad
        kept = kept.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left_anti")
    return kept.select("row.*")
