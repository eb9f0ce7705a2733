"""SimHash near-duplicates with pivot distance tables.

Fingerprints of 64 bits come from the XXH64 values of 4-word shingles. Links
are pairs of different fingerprints at ``MAX_BITS`` or fewer differing bits.
Distances to reference fingerprints alone don't cut the pairs of a large
corpus down (they crowd around 32), so pairs are first proposed by blocks: the
bits lie in b blocks, four changed bits leave b - 4 blocks alike, and each
choice of b - 4 blocks is a key. Among the fingerprints of a key, the table of
Hamming distances to the references discards pairs by their largest coordinate
difference (over ``MAX_BITS``: no link), and survivors are verified. In a key
with many fingerprints, these lie in order of their distance to the first
reference, a range of it holds the candidates of one, and the other references
discard among them; members that are compared so become references themselves,
and pairs of their clusters are compared only if these are near enough and
nothing links them yet. A key with more
than ``CROWD`` fingerprints is cut into chunks by hash, and each two chunks of
it are a group of their own, so no task holds such a key and no pair is lost.

Exact copies share a fingerprint and are never paired. A link needs no pair of
rows: results are a class per document.

Defined results: a null or wordless text has fingerprint zero, linked like any
other; repeated rows share their class; a null doc_id is never a component's
id unless all ids of the component are null; an empty table gives an empty
result; columns other than the id and the text are ignored by ``marked`` and
kept by ``first_rows``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogeo.llm.components import component_labels
from chronogeo.llm.words import word_parts
from chronogeo.session import durable, durable_table, ship_package

MAX_BITS = 4
SHINGLE = 4
SEED = 42
N_PIVOTS = 16
SMALL = 32
#: A key with more fingerprints is cut into chunks of about so many.
CROWD = 16_384
#: Crowded keys are broadcast up to this count, and else joined by shuffle.
MAX_BROADCAST_KEYS = 100_000


def _pivots(n: int) -> np.ndarray:
    """Reference fingerprints, the same in every run: numbers of a mixing generator."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PIVOTS = _pivots(N_PIVOTS)


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of a UTF-8 text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    counts, total, words = np.zeros(64, np.int64), 0, []
    for part in word_parts(data.lower()):  # bytes.lower() touches ASCII only
        words += part
        n = len(words)
        if n < shingle:
            continue
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lengths + 1) - lengths - 1
        first, last = starts[: n - shingle + 1].tolist(), (starts + lengths)[shingle - 1 :].tolist()
        total += len(first)
        for at in range(0, len(first), 65536):
            hashes = [digest(joined[a:b], seed) for a, b in zip(first[at : at + 65536], last[at : at + 65536])]
            bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for lo in range(0, len(hashes), 255):  # sums of bytes that can't overflow
                counts += np.add.reduce(bits[lo : lo + 255], axis=0, dtype=np.uint8)
        words = words[n - shingle + 1 :]  # they begin shingles that go on in the next part
    if not total:
        return digest(b" ".join(words), seed) if words else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """Fingerprint as a signed long."""

    def udf(texts: pa.Array) -> pa.Array:
        from chronogeo.llm.simhash_pivots import fingerprint

        values = [fingerprint(t.as_py() or b"", shingle, seed) for t in texts.cast(pa.binary())]
        return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())

    return F.arrow_udf(udf, "bigint")(text)


def block_masks(n_blocks: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks of all choices of n_blocks - max_bits blocks, as signed longs."""
    edges = [round(i * 64 / n_blocks) for i in range(n_blocks + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(blocks[i] for i in kept) for kept in combinations(range(n_blocks), n_blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(n: int, max_bits: int = MAX_BITS) -> int:
    """The number of blocks with the least expected work for n fingerprints: keys, and pairs within keys."""

    def work(b: int) -> float:
        keys = len(block_masks(b, max_bits))
        return keys * n * (1 + n / 2 ** (64 * (b - max_bits) / b) / 20)

    return min(range(max_bits + 2, max_bits + 7), key=work)


def _distances(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _close(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs link: discarded by the references one after another, then verified."""
    live = np.arange(len(i))
    for p in range(table.shape[1]):
        if not len(live):
            break
        live = live[np.abs(table[i[live], p] - table[j[live], p]) <= max_bits]
    return live[np.bitwise_count(fps[i[live]] ^ fps[j[live]]) <= max_bits]


def _large_group(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join what is linked in a group, at most one per fingerprint and pass."""
    n = len(fps)
    table = _distances(fps)
    order = np.argsort(table[:, 0], kind="stable")
    ranked = table[order, 0].astype(np.int64)
    hub_of = np.full(n, -1, np.int64)
    hubs, out = [], []
    for hub in range(n):
        if hub_of[hub] >= 0:
            continue
        # Candidates are a range of the first reference's distances; the other references discard among them.
        first, last = np.searchsorted(ranked, [table[hub, 0] - max_bits, table[hub, 0] + max_bits + 1])
        free = order[first:last]
        free = free[hub_of[free] < 0]
        near = free[_close(fps, table, np.full(len(free), hub), free, max_bits)]
        hub_of[near] = len(hubs)
        out += [(hub, x) for x in near.tolist() if x != hub]
        hubs.append(hub)
    members = [np.flatnonzero(hub_of == k) for k in range(len(hubs))]
    parent = list(range(len(hubs)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    centres = fps[np.array(hubs)]
    for k in range(len(hubs)):
        apart = np.bitwise_count(centres[k + 1 :] ^ centres[k]).astype(np.int64)
        for m in (np.flatnonzero(apart <= 3 * max_bits) + k + 1).tolist():
            if root(k) == root(m):
                continue
            d = int(apart[m - k - 1])
            mine = members[k][np.bitwise_count(fps[members[k]] ^ centres[m]) <= 2 * max_bits]
            theirs = members[m][np.bitwise_count(fps[members[m]] ^ centres[k]) <= 2 * max_bits]
            if d > 3 * max_bits or not len(mine) or not len(theirs):
                continue
            for at in range(0, len(mine), 1024):
                part = mine[at : at + 1024]
                hit = np.argwhere(np.bitwise_count(fps[part][:, None] ^ fps[theirs][None, :]) <= max_bits)
                if len(hit):
                    out.append((part[hit[0][0]], theirs[hit[0][1]]))
                    parent[root(k)] = root(m)
                    break
    return out


def _links_of_run(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows with equal keys; keys lie in runs."""
    change = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
    begins = np.concatenate([[0], change]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([begins, [len(keys)]]))
    out_a, out_b = [], []
    small = (sizes > 1) & (sizes <= SMALL)
    if small.any():
        rows = np.flatnonzero(np.repeat(small, sizes))
        of, left = np.repeat(np.arange(small.sum()), sizes[small]), fps[rows]
        table = _distances(left)
        for lag in range(1, int(sizes[small].max())):
            i = np.flatnonzero(of[:-lag] == of[lag:])
            hit = i[_close(left, table, i, i + lag, max_bits)]
            out_a.append(left[hit])
            out_b.append(left[hit + lag])
    for b, s in zip(begins[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        group = fps[b : b + s]
        pairs = np.array(_large_group(group, max_bits), np.int64).reshape(-1, 2)
        out_a.append(group[pairs[:, 0]])
        out_b.append(group[pairs[:, 1]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _link_batches(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal keys: all columns but the last, which is the fingerprint."""
    held_k, held_f = None, np.zeros(0, np.uint64)

    def links(keys, fps):
        a, b = _links_of_run(keys, fps, max_bits)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        *own, last = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        keys = np.column_stack(own)
        if held_k is not None:
            keys = np.concatenate([held_k, keys])
        fps = np.concatenate([held_f, last.view(np.uint64)])
        differs = np.flatnonzero(np.any(keys != keys[-1], axis=1))  # the last run may go on
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if cut:
            yield from links(keys[:cut], fps[:cut])
        held_k, held_f = keys[cut:].copy(), fps[cut:].copy()
    if held_k is not None:
        yield from links(held_k, held_f)


def _in_chunks(keyed: DataFrame, crowd: int) -> tuple[DataFrame, list[str]]:
    """Rows of crowded keys once for each pair of chunks (i, j) they belong to, all others with i = j = 0; the columns of a group.

    Keys are counted with sums made before the shuffle, so that no task meets a crowded one.
    """
    crowded = durable(keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select(F.col("choice").alias("c_choice"), F.col("bits").alias("c_bits"), F.ceil(F.col("n") / crowd).cast("int").alias("chunks")))
    n = crowded.count()
    if not n:
        return keyed, ["choice", "bits"]
    crowded = F.broadcast(crowded) if n <= MAX_BROADCAST_KEYS else crowded
    rows = keyed.join(crowded, (F.col("choice") == F.col("c_choice")) & (F.col("bits") == F.col("c_bits")), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.filter("chunks = 1 OR own <> other")  # two chunks together hold the pairs within each
    return rows.select("choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"), ["choice", "bits", "i", "j"]


def links(fps: DataFrame, max_bits: int = MAX_BITS, n_blocks: int | None = None, crowd: int = CROWD) -> DataFrame:
    """(a, b) links among distinct fingerprints (column fp) that join all that is linked."""
    spark = fps.sparkSession
    ship_package(spark)
    masks = block_masks(n_blocks or blocks_for(fps.count(), max_bits), max_bits)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "bits"))
    keyed, group = _in_chunks(keyed.select("choice", "bits", "fp"), crowd)
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = keyed.repartition(parts, *group).sortWithinPartitions(*group)

    def run(batches):
        from chronogeo.llm.simhash_pivots import _link_batches

        return _link_batches(batches, max_bits)

    return keyed.mapInArrow(run, "a bigint, b bigint").distinct()


def classes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS, n_blocks: int | None = None) -> DataFrame:
    """doc_id, fp (signed long), component_id, label (a fingerprint of the class), one row per input row."""
    ship_package(docs.sparkSession)
    rows = durable(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text)).alias("fp")))
    firsts = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = component_labels(links(firsts.select("fp"), max_bits, n_blocks)).withColumnRenamed("node", "fp")
    named = firsts.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    # A table of its own, so that Spark can split a component that holds very many fingerprints.
    named, least = durable(named), durable(named.groupBy("label").agg(F.min("first").alias("component_id")))
    return rows.join(named.join(least, "label").select("fp", "label", "component_id"), "fp").select("doc_id", "fp", "component_id", "label")


def marked(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return classes(docs, **options).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One of the input's rows for each class: that with the least doc_id (of several such, the least text hash).

    Rows without doc_id that share a class with a doc_id go; of a class
    without any doc_id one row stays.
    """
    names = docs.columns
    marks = classes(docs, text=text, doc_id=doc_id, **options)
    heads = marks.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "label").agg(F.min("fp").alias("fp"))
    heads = heads.groupBy(F.col("doc_id").alias("k_id")).agg(F.collect_set("fp").alias("k_fps"))
    times = marks.groupBy(F.col("doc_id").alias("n_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    heads = durable(heads.join(times, F.col("k_id").eqNullSafe(F.col("n_id"))).select("k_id", "k_fps", "n_rows"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{doc_id}`").alias("id"))
    one = rows.join(heads.filter("n_rows = 1"), F.col("id").eqNullSafe(F.col("k_id"))).select("row.*")
    many = heads.filter("n_rows > 1")
    if many.isEmpty():
        return one
    # Rows that repeat a doc_id: one row for each of its fingerprints that stays.
    several = durable_table(rows.join(many, F.col("id").eqNullSafe(F.col("k_id"))).select("row", "id", "k_fps"))
    several = several.withColumn("t", F.col(f"row.`{text}`")).withColumn("fp", fingerprint_column(F.col("t"))).filter(F.array_contains("k_fps", F.col("fp")))
    nth = F.row_number().over(Window.partitionBy("id", "fp").orderBy(F.xxhash64("t")))
    return one.unionByName(several.withColumn("nth", nth).filter("nth = 1").select("row.*"))
