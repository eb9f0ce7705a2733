"""Substring dedup by compaction of a de Bruijn graph of token k-mers.

Contract: a window is ``WINDOW`` consecutive words of one document; a word goes
if a window covers it whose word sequence also starts earlier (smaller doc_id,
or same document and earlier start).

Nodes are seeds: of the k-mers in a window, the one with the least hash. Equal
windows hold equal seeds at equal places, so only seeds that occur twice or
more matter. All windows in a row with the same seed make one edge, a k-mer of
``WINDOW`` words or more, that leads to the next edge of its text; edges with
equal content (seed hash and a hash of all windows) are one edge of the graph
with many source coordinates (document, start). Steps:

1. Seeds are counted over the corpus. Repeated ones go into a bit table of
   bounded size (``FILTER_BITS``), which is all that is broadcast. A full table
   lets needless edges pass and changes no result.
2. Edges with a passing seed are grouped by content: their number, their first
   source coordinate, and the edge that follows them, if it is always one.
3. Compaction: an edge that is always followed by one and the same edge, as
   often as that occurs, and at its first coordinate too, is a nonbranching
   step. A join finds these steps, and joins that double their reach lead
   every edge of a nonbranching path back to the path's first edge. A path is
   one node then, with a length and a first source coordinate.
4. Only first edges of paths are read from the texts again and joined with
   their paths: an occurrence that isn't the first goes with all its windows.
5. A seed with several different edges is a branch of the graph: such edges
   may share windows. They are read once more with all windows, each distinct
   edge is opened at its first coordinate, and a join finds windows that
   another edge has earlier.
6. Spans (document, start, windows, source document, source start) meet their
   texts in one join, at both ends: words at the span and at its source
   coordinate are hashed by 128 bits of BLAKE2, and these must agree. Where any
   two don't, two different k-mers had one hash, and all is done again with
   other hash functions: no word goes that isn't proved a copy, and equal
   windows always have equal hashes, so none is missed.

Defined results: a null text has no words; rows that repeat a doc_id with
another text are documents of their own, ordered by a SHA-256 hash of the
text, and identical rows keep their words alike; a null doc_id counts as
smaller than any other; ids of any type that Spark can order may be used; an
empty table gives an empty result; columns other than the id and the text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from chronogeo.session import durable, durable_table, ship_package

WINDOW = 20
K = 8
#: Most bits of a table of seeds; it has 16 for each seed up to this size.
FILTER_BITS = 1 << 30
ATTEMPTS = 8
PART_BYTES = 2 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
#: Words of more bytes are hashed one by one, as sums of powers modulo 2^64 collide for some long words at any base.
LONG_WORD = 64
#: at: start in words; following: content of the edge that follows in the text, 0 for none that passes.
EDGE_DDL = "seed bigint, content bigint, n int, doc bigint, at int, following bigint"
OPEN_DDL = EDGE_DDL + ", windows array<bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _base(constant: int, salt: int) -> int:
    """An odd number for each salt."""
    return (constant + salt * 0x9FB21C651E98DF24) & ((1 << 64) - 1) | 1


def word_hashes(data: bytes, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and where it starts, for bytes in which blanks part words."""
    b = np.frombuffer(data, np.uint8)
    word = ~_BLANK[b]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, _U), starts
    lengths = ends - starts
    inside = np.flatnonzero(word)
    offset = inside - np.repeat(starts, lengths)
    values = (b[inside].astype(_U) + _U(1)) * _powers(_base(0x9E3779B97F4A7C15, salt), int(lengths.max()))[offset]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out = _mix(np.add.reduceat(values, first) ^ (lengths.astype(_U) << _U(56)))
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], salt)
    return out, starts


def _rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of each run of k words, by doubling."""
    size, level = 1, h
    levels = {1: h}
    while size * 2 <= k:
        level = level[: len(level) - size] + _U(pow(base, size, 1 << 64)) * level[size:]
        size *= 2
        levels[size] = level
    at, total = 0, None
    for size in sorted(levels, reverse=True):
        while at + size <= k:
            part = levels[size][at : len(h) - k + 1 + at]
            total = part if total is None else total + _U(pow(base, at, 1 << 64)) * part
            at += size
    return _mix(total)


def _least_in(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value (leftmost of several) in each run of width values."""
    index = np.arange(len(h))
    size = 1
    while size * 2 <= width:
        a, b = index[:-size], index[size:]
        index = np.where(h[b] < h[a], b, a)
        size *= 2
    if size < width:
        a, b = index[: len(h) - width + 1], index[width - size :]
        index = np.where(h[b] < h[a], b, a)
    return index


def edges_of(texts: list[bytes], seeds_only: bool, salt: int = 0, window: int = WINDOW, k: int = K):
    """Edges of a few texts: text number, start (in words), number of windows, seed hash, and window hashes in a row.

    Texts are joined by a blank and hashed together; windows across two texts are left out.
    """
    data = b" ".join(texts)
    h, starts = word_hashes(data, salt)
    ends = np.cumsum([len(t) + 1 for t in texts])
    text_of = np.searchsorted(ends, starts, side="right")
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none.view(_U), none.view(_U)
    kmers = _rolling(h, k, _base(0xD6E8FEB86659FD93, salt))
    least = _least_in(kmers, window - k + 1)
    valid = text_of[: len(h) - window + 1] == text_of[window - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none.view(_U), none.view(_U)
    least = least[at]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)])
    begin = np.flatnonzero(new)
    counts = np.diff(np.concatenate([begin, [len(at)]]))
    first_word = np.searchsorted(text_of, np.arange(len(texts)))
    of = text_of[at[begin]]
    windows = none.view(_U) if seeds_only else _rolling(h, window, _base(0xA0761D6478BD642F, salt))[at]
    return of, at[begin] - first_word[of], counts, kmers[least[begin]], windows


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of a batch, in parts of bounded size."""
    ids, rows, size = [], [], 0
    texts = batch.column(1).cast(pa.binary())
    for i, d in zip(range(batch.num_rows), batch.column(0).to_pylist()):
        t = texts[i].as_py() or b""
        ids.append(d)
        rows.append(t)
        size += len(t)
        if size >= PART_BYTES:
            yield ids, rows
            ids, rows, size = [], [], 0
    if rows:
        yield ids, rows


def _seed_batches(batches: Iterator[pa.RecordBatch], salt: int) -> Iterator[pa.RecordBatch]:
    """Seeds with their number of edges in a part, as 0 (once) or 1 (several times)."""
    for batch in batches:
        for _, texts in _parts(batch):
            seeds, n = np.unique(edges_of(texts, True, salt)[3], return_counts=True)
            if len(seeds):
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array((n > 1).astype(np.int8))], names=["seed", "more"])


def slots(seeds: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(seeds ^ _U(0x5851F42D4C957F2D)) % _U(bits)).astype(np.int64)


def _edge_batches(batches: Iterator[pa.RecordBatch], table: np.ndarray, opened: bool, salt: int) -> Iterator[pa.RecordBatch]:
    bits = len(table) * 8
    for batch in batches:
        for ids, texts in _parts(batch):
            of, start, counts, seeds, windows = edges_of(texts, False, salt)
            if not len(of):
                continue
            slot = slots(seeds, bits)
            keep = np.flatnonzero((table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            if not len(keep):
                continue
            begin = np.cumsum(counts) - counts
            n = counts[keep]
            offsets = np.concatenate([[0], np.cumsum(n)])
            within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
            own = windows[np.repeat(begin[keep], n) + within]
            content = np.add.reduceat(own * _powers(_base(0xE7037ED1A0B428DB, salt), int(n.max()))[within], offsets[:-1])
            content = _mix(content ^ _mix(seeds[keep] + n.astype(_U))).view(np.int64)
            # The next edge of a text begins where the windows of this one end.
            along = (keep[1:] == keep[:-1] + 1) & (of[keep[1:]] == of[keep[:-1]])
            following = np.append(np.where(along, content[1:], 0), 0)
            doc = np.array(ids, np.int64)[of[keep]]
            columns = [pa.array(seeds[keep].view(np.int64)), pa.array(content), pa.array(n.astype(np.int32)), pa.array(doc), pa.array(start[keep].astype(np.int32)), pa.array(following)]
            names = ["seed", "content", "n", "doc", "at", "following"]
            if opened:
                columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(own.view(np.int64))))
                names.append("windows")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def bit_table(seeds: DataFrame, bits: int) -> np.ndarray:
    """Bit table of a column of seeds, of 16 bits for each, and of the given number at most."""
    bits = min(bits, max(64, 1 << (16 * seeds.count()).bit_length()))

    def place(batches):
        import numpy as np
        import pyarrow as pa

        from chronogeo.llm.substring_graph import slots

        for batch in batches:
            slot = slots(batch.column(0).to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(np.left_shift(np.int64(1), slot & 63))], names=["word", "mask"])

    found = seeds.mapInArrow(place, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    if found.num_rows:
        table[found["word"].to_numpy()] = found["mask"].to_numpy()
    return table.view(np.uint8)


def repeated_seeds(docs: DataFrame, salt: int = 0) -> DataFrame:
    """Seeds that occur twice or more in the corpus."""

    def count(batches):
        from chronogeo.llm.substring_graph import _seed_batches

        return _seed_batches(batches, salt)

    seeds = docs.mapInArrow(count, "seed bigint, more tinyint").groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.max("more").alias("more"))
    return durable(seeds.filter("n > 1 OR more > 0").select("seed"))


def edges(docs: DataFrame, table: np.ndarray, opened: bool = False, salt: int = 0) -> DataFrame:
    """Every occurrence of an edge whose seed is in a bit table, with its windows if opened."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def emit(batches):
        from chronogeo.llm.substring_graph import _edge_batches

        return _edge_batches(batches, shared.value, opened, salt)

    return docs.mapInArrow(emit, OPEN_DDL if opened else EDGE_DDL)


def compacted(repeated: DataFrame) -> DataFrame:
    """seed, content, windows, src_doc, src_at of each nonbranching path: its first edge, length and first coordinate.

    repeated has seed, content, n, doc, at (first coordinate), times and
    following (the only edge that follows, 0 if there is none or several).
    Steps go forward in the source document, so paths hold no circle.
    """
    ahead = repeated.filter("following <> 0").select(F.col("content").alias("before"), F.col("following"), F.col("times").alias("b_times"), F.col("doc").alias("b_doc"), (F.col("at") + F.col("n")).alias("b_end"))
    same = (F.col("times") == F.col("b_times")) & (F.col("doc") == F.col("b_doc")) & (F.col("at") == F.col("b_end"))
    steps = durable_table(ahead.join(repeated.drop("following"), (F.col("following") == F.col("content")) & same).select("content", F.col("before").alias("head"), F.lit(False).alias("done")))
    state = steps
    while True:
        back = state.select(F.col("content").alias("node"), F.col("head").alias("further"), F.col("done").alias("known"))
        # A node without a step before it is the first of its path.
        state = durable_table(
            state.filter("NOT done").join(back, F.col("head") == F.col("node"), "left")
            .select("content", F.coalesce("further", "head").alias("head"), (F.col("further").isNull() | F.coalesce("known", F.lit(False))).alias("done"))
            .unionByName(state.filter("done"))
        )
        if state.filter("NOT done").isEmpty():
            break
    of = state.select(F.col("content").alias("node"), "head")
    labelled = repeated.join(of, F.col("content") == F.col("node"), "left").withColumn("path", F.coalesce("head", "content"))
    first = F.min_by(F.struct("seed", "doc", "at"), F.struct(F.col("head").isNotNull(), F.col("at"))).alias("first")
    return labelled.groupBy("path").agg(F.sum("n").cast("int").alias("windows"), first).select(F.col("first.seed").alias("seed"), F.col("path").alias("content"), "windows", F.col("first.doc").alias("src_doc"), F.col("first.at").alias("src_at"))


def repeated_spans(docs: DataFrame, bits: int = FILTER_BITS, salt: int = 0) -> DataFrame:
    """doc, at, n, src_doc, src_at: runs of n windows that start earlier elsewhere."""
    here = F.struct("doc", "at")
    every = edges(docs, bit_table(repeated_seeds(docs, salt), bits), salt=salt)
    one = F.when(F.min("following") == F.max("following"), F.min("following")).otherwise(F.lit(0)).alias("following")
    distinct = every.groupBy("seed", "content", "n").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("times"), one)
    distinct = durable_table(distinct.select("seed", "content", "n", "first.doc", "first.at", "times", "following"))
    paths = durable_table(compacted(distinct.filter("times > 1")).select(F.col("seed").alias("p_seed"), F.col("content").alias("p_content"), "windows", "src_doc", "src_at"))
    heads = edges(docs, bit_table(paths.select("p_seed").distinct(), bits), salt=salt).select("seed", "content", "doc", "at")
    copies = heads.join(paths, (F.col("seed") == F.col("p_seed")) & (F.col("content") == F.col("p_content")))
    copies = copies.select("doc", "at", F.col("windows").alias("n"), "src_doc", "src_at")
    branching = durable(distinct.groupBy("seed").agg(F.count(F.lit(1)).alias("edges")).filter("edges > 1").select("seed"))
    opened = edges(docs, bit_table(branching, bits), True, salt).groupBy("seed", "content", "n").agg(F.min(here).alias("first"), F.first("windows").alias("windows"))
    opened = opened.select("seed", F.col("first.doc").alias("doc"), F.col("first.at").alias("edge"), F.posexplode("windows").alias("i", "window"))
    opened = opened.select("seed", "window", "doc", (F.col("edge") + F.col("i")).alias("at"))
    shared = opened.groupBy("seed", "window").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    shared = shared.select(F.col("seed").alias("f_seed"), F.col("window").alias("f_window"), F.col("first.doc").alias("src_doc"), F.col("first.at").alias("src_at"))
    later = opened.join(shared, (F.col("seed") == F.col("f_seed")) & (F.col("window") == F.col("f_window")))
    later = later.select("doc", "at", F.lit(1).alias("n"), "src_doc", "src_at")
    return copies.unionByName(later).filter("doc <> src_doc OR at <> src_at")


def packed(text: bytes | None) -> bytes:
    """A text compressed for the one shuffle of texts, its size first."""
    return len(text).to_bytes(8, "big") + pa.compress(text, codec="zstd", asbytes=True) if text else b""


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "big"), codec="zstd", asbytes=True) if data else b""


def _packed_column(text):
    def udf(texts: pa.Array) -> pa.Array:
        from chronogeo.llm.substring_graph import packed

        return pa.array([packed(t.as_py()) for t in texts.cast(pa.binary())], pa.binary())

    return F.arrow_udf(udf, "binary")(text)


PROOF = pa.struct([("src_doc", pa.int64()), ("src_at", pa.int32()), ("n", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])
KEPT_DDL = "n_words bigint, n_removed bigint, kept_sha256 string, proofs array<struct<src_doc:bigint,src_at:int,n:int,high:bigint,low:bigint>>"


def _kept_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text, and hashes of the words at its spans and at spans that others have from it."""
    for batch in batches:
        out, proofs, offsets = [[], [], [], []], [[], [], [], [], []], [0]
        texts, columns = batch.column(2).cast(pa.binary()), [batch.column(i).to_pylist() for i in (0, 1, 3)]
        for i, (doc, key, spans) in enumerate(zip(*columns)):
            words = unpacked(texts[i].as_py()).split()
            kept, at = [], 0
            for s in sorted(spans or (), key=lambda s: (s["at"], s["n"])):
                start, end = s["at"], s["at"] + s["n"] + WINDOW - 1
                digest = hashlib.blake2b(b" ".join(words[start:end]), digest_size=16).digest()
                for column, value in zip(proofs, (s["src_doc"], s["src_at"], s["n"], int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True))):
                    column.append(value)
                if s["src_doc"] != key or s["src_at"] != start:
                    if start > at:
                        kept += words[at:start]
                    at = max(at, end)
            kept += words[at:]
            offsets.append(len(proofs[0]))
            for column, value in zip(out, (doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())):
                column.append(value)
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(proofs, PROOF)], fields=list(PROOF)))
        types = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, types)), listed], names=["doc_id", "n_words", "n_removed", "kept_sha256", "proofs"])


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """key (long, in the order of documents, one for each distinct document), text, doc_id.

    Ids that are whole numbers, none repeated, are keys themselves. All others are numbered: distinct ids and texts are sorted
    into ranges, and a number is the place in a range and the size of the ranges before it.
    """
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    if isinstance(rows.schema["doc_id"].dataType, IntegralType):
        ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        if ids.filter("n > 1 OR doc_id IS NULL").isEmpty():
            return rows.select(F.col("doc_id").cast("long").alias("key"), "text", "doc_id")
    rows = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest")]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = durable(rows.select("doc_id", "digest").distinct().repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy("range").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    numbers = ranges.withColumn("place", place).join(F.broadcast(sizes.drop("count")), "range")  # one row for each range
    numbers = durable(numbers.select(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest"), (F.col("before") + F.col("place")).alias("key")))
    joined = rows.join(numbers, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("digest") == F.col("k_digest")))
    return durable_table(joined.select("key", "text", "doc_id"))


def proved(kept: DataFrame) -> bool:
    """Whether the words at all spans equal those at their source coordinates."""
    proofs = kept.select(F.explode("proofs").alias("p")).select("p.*")
    hashes = F.struct("high", "low")
    return proofs.groupBy("src_doc", "src_at", "n").agg(F.min(hashes).alias("least"), F.max(hashes).alias("most")).filter("least <> most").isEmpty()


def attempt(rows: DataFrame, bits: int, salt: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, proofs of keyed documents, by the hash functions of a salt."""
    spans = durable_table(repeated_spans(rows.select("key", "text"), bits, salt))
    sources = spans.select(F.col("src_doc").alias("doc"), F.col("src_at").alias("at"), "n", "src_doc", "src_at").distinct()
    by_doc = spans.unionByName(sources).groupBy("doc").agg(F.collect_list(F.struct("at", "n", "src_doc", "src_at")).alias("spans"))
    joined = rows.select("doc_id", "key", _packed_column(F.col("text")).alias("packed")).join(by_doc, F.col("key") == F.col("doc"), "left").select("doc_id", "key", "packed", "spans")

    def run(batches):
        from chronogeo.llm.substring_graph import _kept_batches

        return _kept_batches(batches)

    return durable_table(joined.mapInArrow(run, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, {KEPT_DDL}"))


def deduplicated(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row per input row."""
    ship_package(docs.sparkSession)
    rows = keyed(docs, text, doc_id)
    for salt in range(ATTEMPTS):
        kept = attempt(rows, bits, salt)
        if proved(kept):
            return kept.drop("proofs")
    raise RuntimeError(f"hashes of different words agreed in each of {ATTEMPTS} attempts")
