"""Phrase collocations by language: packed id n-grams, range-partitioned, sorted, and counted by runs.

Words that occur less often than a phrase must cannot be part of one. The
words of ``MIN_COUNT`` or more occurrences in their language get dense ids of
32 bits, and pieces break at all others. Up to four ids are packed into a key of
128 bits (two longs). A chunk of texts orders its keys by a radix sort of 16-bit
digits and counts runs; keys of all chunks are partitioned by ranges, sorted
and their runs added up.

The dictionary is never sent to a task as a whole: texts are numbered in chunks
with a numbering of their own, each chunk's words meet the dictionary in a
join, and the chunk gets the ids of its own words. Three- and four-word keys are
only written where the shorter phrases in them may be frequent: a bit table of
``FILTER_BITS`` at most tells that. It passes all frequent ones; when a corpus
has so many that it fills up, more keys are shuffled and the results stay the same.

Defined results: A-Z is lower-cased; a null text is empty, a null language is
``und``; repeated rows count each time; ties go by occurrences, then by the
phrase's bytes; an empty table gives an empty result; columns other than the
language and the text are ignored, whatever their names. Texts of any length
are read in parts that end where a piece ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chronogeo.session import durable, durable_table, ship_package

LONGEST = 4
MIN_COUNT = 30
TOP = 2000
SCALE = 2_000_000
COVERED_PERCENT = 80
CHUNK_WORDS = 1 << 21
CHUNK_DISTINCT = 1 << 19
PART = 1 << 20
FILTER_BITS = 1 << 26
LOW = 0xFFFFFFFF
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_BREAK = re.compile(b"[%s]" % re.escape(SEPARATORS))
_PLAIN = bytes.maketrans(SEPARATORS + b"\t", b"\n" * len(SEPARATORS) + b" ")
CODED = "chunk bigint, lang string, word string, local int, n bigint, ids binary"
COUNTS = "hi bigint, lo bigint, n bigint"


class _Numbers(dict):
    """Numbers of a language's words in a chunk; all languages share the count."""

    def __init__(self, counter: list[int]):
        super().__init__({b"": -1, b"\n": 0})
        self.counter = counter

    def __missing__(self, key):
        self.counter[0] += 1
        self[key] = self.counter[0]
        return self.counter[0]


def _parts(data: bytes, size: int = PART) -> Iterator[bytes]:
    """Parts of a text of about a size, each but the last up to a separator, and with it."""
    at = 0
    while at < len(data):
        stop = _BREAK.search(data, at + size) if len(data) > at + size else None
        end = stop.end() if stop else len(data)
        yield data[at:end]
        at = end


def _coded_batches(batches: Iterator[pa.RecordBatch], task: int, chunk_words: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chunks as rows of words (with their number and count in the chunk) and one row of the numbers in a row; 0 ends a piece."""
    chunk, counter, words, flat, held = task << 32, [0], {}, [], 0
    end = np.zeros(1, np.int32)

    def flush():
        ids = np.concatenate(flat)
        counts = np.bincount(ids, minlength=counter[0] + 1)
        fill = lambda rows, **columns: pa.RecordBatch.from_pydict({f.name: columns.get(f.name, pa.nulls(rows, f.type)) for f in schema}, schema=schema)
        for lang, numbers in words.items():
            own = list(numbers)[2:]
            for at in range(0, len(own), 50_000):
                part = own[at : at + 50_000]
                local = np.fromiter(map(numbers.__getitem__, part), np.int32, len(part))
                yield fill(len(part), chunk=pa.array(np.full(len(part), chunk)), lang=pa.array([lang] * len(part), schema.field("lang").type), word=pa.array(part, pa.binary()).cast(schema.field("word").type), local=pa.array(local), n=pa.array(counts[local]))
        yield fill(1, chunk=pa.array([chunk]), ids=pa.array([ids.tobytes()], pa.binary()))

    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for lang, t in zip(batch.column(0).to_pylist(), texts):
            for part in _parts(t.as_py() or b""):
                numbers = words.get(lang)
                if numbers is None:
                    numbers = words[lang] = _Numbers(counter)
                tokens = part.lower().translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
                ids = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
                flat += [ids[ids >= 0], end]
                held += len(tokens)
                if held >= chunk_words or counter[0] >= CHUNK_DISTINCT:
                    yield from flush()
                    chunk, counter, words, flat, held = chunk + 1, [0], {}, [], 0
    if flat:
        yield from flush()


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows of ids, first column first, by least significant digits of 16 bits."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in (0, 16):
            digit = (column >> shift & 0xFFFF).astype(np.uint16)
            if shift == 0 or digit.any():
                order = order[np.argsort(digit[order], kind="stable")]  # of 16-bit numbers: a radix sort
    return order


def packed_runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct packed keys (hi, lo) in order, and the length of their runs."""
    order = radix_order(columns)
    c = [x[order].astype(np.int64) for x in columns] + [np.zeros(len(order), np.int64)] * (4 - len(columns))
    return _runs(c[0] << 32 | c[1], c[2] << 32 | c[3], np.ones(len(order), np.int64))


def _runs(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(hi):
        return hi, lo, n
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
    return hi[first], lo[first], np.add.reduceat(n, first)


def slots(hi: np.ndarray, lo: np.ndarray, n_bits: int) -> np.ndarray:
    """Places of keys in a bit table."""
    x = hi.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n_bits)).astype(np.int64)


def _grams(ids: np.ndarray, size: int, table: np.ndarray | None) -> list[np.ndarray]:
    """Columns of all n-grams of a size within pieces, whose shorter ones the table passes."""
    if len(ids) < size:
        return [np.zeros(0, np.int32)] * size
    columns = [ids[k : len(ids) - size + 1 + k] for k in range(size)]
    live = np.all([c > 0 for c in columns], axis=0)
    columns = [c[live] for c in columns]
    if table is not None:
        c = [x.astype(np.int64) for x in columns] + [np.zeros(len(columns[0]), np.int64)] * 2
        keep = np.ones(len(c[0]), bool)
        for k in (0, 1):
            shorter = [c[k + i] if i < size - 1 else np.zeros(len(c[0]), np.int64) for i in range(4)]
            at = slots(shorter[0] << 32 | shorter[1], shorter[2] << 32 | shorter[3], 64 * len(table))
            keep &= (table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        columns = [x[keep] for x in columns]
    return columns


def _count_batches(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(hi), 500_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 500_000]) for x in (hi, lo, n)], names=["hi", "lo", "n"])


def _sum_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sums of runs of equal keys that reach a least count; a run may go on in the next batch."""
    hold = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        own = [np.concatenate([h, c.to_numpy()]) for h, c in zip(hold, batch.columns)]
        hi, lo, n = _runs(*own)
        if len(hi):
            hold = [x[-1:].copy() for x in (hi, lo, n)]
            enough = n[:-1] >= least
            yield from _count_batches(*(x[:-1][enough] for x in (hi, lo, n)))
    if len(hold[0]) and hold[2][0] >= least:
        yield from _count_batches(*hold)


def _dense(df: DataFrame) -> DataFrame:
    """The rows as a durable table with ids from 1 on, as many as the longest partition times the partitions."""
    rows = durable_table(df.withColumn("part", F.spark_partition_id().cast("long")).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    most = rows.agg(F.max("part").alias("part"), F.max("row").alias("row")).first()
    parts = (most["part"] or 0) + 1
    if parts * ((most["row"] or 0) + 1) >= 1 << 31:
        raise ValueError("more frequent words than ids of 32 bits")
    return rows.withColumn("id", (F.col("row") * parts + F.col("part") + 1).cast("int")).drop("part", "row")


def _added(counts: DataFrame, least: int) -> DataFrame:
    """(hi, lo, n) of frequent keys from counts of chunks: range partitions, sorted, runs added up."""
    parts = max(12, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        from chronogeo.llm.collocations import _sum_batches

        return _sum_batches(batches, least)

    return durable_table(counts.repartitionByRange(parts, "hi", "lo").sortWithinPartitions("hi", "lo").mapInArrow(run, COUNTS))


def _bit_table(frequent: DataFrame):
    """Broadcast bit table of frequent keys, 16 bits for each and ``FILTER_BITS`` at most."""
    n_bits = 1 << 16
    while n_bits < min(16 * frequent.count(), FILTER_BITS):
        n_bits *= 2

    def run(batches):
        from chronogeo.llm.collocations import slots

        for batch in batches:
            at = slots(batch.column(0).to_numpy(), batch.column(1).to_numpy(), n_bits)
            word, of = np.unique(at >> 6, return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, of, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = frequent.select("hi", "lo").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(n_bits // 64, np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(table)


def _chunk_grams(coded: DataFrame, size: int, table) -> DataFrame:
    """(hi, lo, n) of each chunk's n-grams."""

    def run(batches):
        from chronogeo.llm.collocations import _count_batches, _grams, packed_runs

        for batch in batches:
            for ids in batch.column(0):
                yield from _count_batches(*packed_runs(_grams(np.frombuffer(ids.as_py(), np.int32), size, table.value if table else None)))

    return durable_table(coded.select("ids").mapInArrow(run, COUNTS))


def counted(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, chunk_words: int = CHUNK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (hi, lo, n) of all frequent phrases of 1 to 4 words, the dictionary (id, lang, word, n), and (lang, n) of all words."""
    spark = docs.sparkSession
    ship_package(spark)
    schema = to_arrow_schema(StructType.fromDDL(CODED))

    def number(batches):
        from pyspark import TaskContext

        from chronogeo.llm.collocations import _coded_batches

        return _coded_batches(batches, TaskContext.get().partitionId(), chunk_words, schema)

    coded = durable_table(docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text")).mapInArrow(number, CODED))
    words = coded.filter("word IS NOT NULL")
    dictionary = _dense(words.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    told = words.join(dictionary.select(F.col("lang").alias("d_lang"), F.col("word").alias("d_word"), "id"), (F.col("lang") == F.col("d_lang")) & (F.col("word") == F.col("d_word")))
    told = told.select(F.col("chunk").alias("t_chunk"), "local", "id")

    def recode(left, right):
        ids = np.frombuffer(left["ids"][0].as_py(), np.int32)
        table = np.zeros(int(ids.max(initial=0)) + 1, np.int32)
        table[right["local"].to_numpy()] = right["id"].to_numpy()
        out = table[ids]
        out = out[(out > 0) | np.concatenate([[False], out[:-1] > 0])]  # a break once
        return pa.table({"ids": pa.array([out.tobytes()], pa.binary())})

    chunks = durable_table(coded.filter("ids IS NOT NULL").select("chunk", "ids").groupBy("chunk").cogroup(told.groupBy("t_chunk")).applyInArrow(recode, "ids binary"))
    levels = [dictionary.select(F.shiftleft(F.col("id").cast("long"), 32).alias("hi"), F.lit(0).cast("long").alias("lo"), "n")]
    table = None
    for size in range(2, LONGEST + 1):
        levels.append(_added(_chunk_grams(chunks, size, table), least))
        table = _bit_table(levels[-1]) if size < LONGEST else None
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    return counts, dictionary, totals


def _ids(hi: Column, lo: Column) -> Column:
    """Array of a key's ids."""
    low = F.lit(LOW)
    return F.filter(F.array(F.shiftright(hi, 32), hi.bitwiseAND(low), F.shiftright(lo, 32), lo.bitwiseAND(low)), lambda x: x > 0)


def _key(ids: Column) -> list[Column]:
    """hi and lo of an array of ids."""
    at = lambda i: F.coalesce(F.get(ids, F.lit(i)), F.lit(0).cast("long"))
    return [F.shiftleft(at(0), 32).bitwiseOR(at(1)).alias("hi"), F.shiftleft(at(2), 32).bitwiseOR(at(3)).alias("lo")]


def scored(counts: DataFrame) -> DataFrame:
    """hi, lo, ids, a, l, r, score of every phrase of two words or more that no longer one stands for."""
    every = counts.select("hi", "lo", "n", _ids(F.col("hi"), F.col("lo")).alias("ids"))
    phrases = every.filter(F.size("ids") > 1)
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    half = lambda name, ids: F.struct(*_key(ids)).alias(name)
    cuts = cuts.select("hi", "lo", "n", "k", half("left", F.slice("ids", F.lit(1), F.col("k"))), half("right", F.slice("ids", F.col("k") + 1, F.size("ids"))))
    part = lambda name: counts.select(F.col("hi").alias(f"{name}_hi"), F.col("lo").alias(f"{name}_lo"), F.col("n").alias(name))
    cuts = cuts.join(part("l"), (F.col("left.hi") == F.col("l_hi")) & (F.col("left.lo") == F.col("l_lo")))
    cuts = cuts.join(part("r"), (F.col("right.hi") == F.col("r_hi")) & (F.col("right.lo") == F.col("r_lo")))
    wide = lambda c: f"cast({c} AS decimal(19,0))"
    score = F.expr(f"cast(cast({SCALE} AS decimal(7,0)) * {wide('n')} div ({wide('l')} + {wide('r')}) AS bigint)")
    best = cuts.groupBy("hi", "lo", F.col("n").alias("a")).agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = phrases.filter(F.size("ids") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.size("ids") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("size") + 1)))
    longer = longer.select("n", F.slice("ids", F.col("at"), F.col("size")).alias("sub")).select("n", *_key(F.col("sub")))
    longer = longer.groupBy(F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo")).agg(F.max("n").alias("most"))
    best = best.join(longer, (F.col("hi") == F.col("s_hi")) & (F.col("lo") == F.col("s_lo")), "left")
    best = best.filter(F.expr(f"most IS NULL OR cast(100 AS decimal(3,0)) * {wide('most')} < cast({COVERED_PERCENT} AS decimal(3,0)) * {wide('a')}"))
    return best.select("hi", "lo", _ids(F.col("hi"), F.col("lo")).alias("ids"), "a", "cut.l", "cut.r", "cut.score")


def mined(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, top: int = TOP, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases."""
    counts, dictionary, totals = counted(docs, text=text, lang=lang, least=least, chunk_words=chunk_words)
    rows = scored(counts).join(dictionary.select(F.col("id").alias("d_id"), "lang"), F.get("ids", F.lit(0)) == F.col("d_id")).drop("d_id")
    # Ties with the last are kept until the phrase's words tell.
    rows = durable(rows.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("rank") <= top))
    spelled = rows.select("hi", "lo", F.posexplode("ids").alias("at", "of")).join(dictionary.select(F.col("id").alias("w_id"), "word"), F.col("of") == F.col("w_id"))
    spelled = spelled.groupBy(F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = rows.join(spelled, (F.col("hi") == F.col("p_hi")) & (F.col("lo") == F.col("p_lo")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return rows.join(totals.withColumnRenamed("lang", "t_lang"), F.col("lang") == F.col("t_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
