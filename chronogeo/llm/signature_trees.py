"""Jaccard join of documents' word shingles with signature trees.

A document's set are the hashes (XXH64) of its distinct shingles. Sets link
when their Jaccard index is at least ``PERCENT`` of 100. Results are a class
per document; the pairs of a class are never listed.

*Forest.* One tree over all sets would compare almost every two of its nodes,
since OR-combined bitmaps of unrelated documents fill up. Sets are therefore
dealt to trees first, in a way that separates no link: two linked sets of a
size class differ in at most D elements, so of D + 1 + ``SPARE`` segments (by
hash of the element) more than ``SPARE`` are alike; each set names its
segments by their hashes, and sets that share a segment are of one tree, along
with all they share segments with (a set with more than ``SPARE`` empty
segments names these too). Only hashes of segments are shuffled; texts are
read once more for sets that share any.

*Tree.* The sets of a tree, in order of their least elements, are leaves; nodes
above hold the OR-combined bitmaps and the size ranges of ``FAN`` nodes each.
A dual traversal from the root with itself goes down level by level and drops
pairs of nodes whose size ranges can't link, or whose greatest possible overlap
(bits that both have, and elements that share a bit with others) is less than
their least sizes need. Pairs of sets that are left, and that no chain of
links joins yet, are compared exactly. A tree of more than ``CROWD_SETS`` sets
or ``CROWD_ELEMENTS`` elements is cut into chunks, and each two chunks are
traversed by a task of their own: no task holds such a tree and no link is lost.

Defined results: null and wordless texts have an empty set and are classes of
their own; fewer words than a shingle has are one element; repeated rows and
equal sets share a class; a null doc_id is never a component's id unless all
ids of the class are null, a document without words has its own id; an empty
table gives an empty result; columns other than the id and the text are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chronogeo.llm.components import component_labels
from chronogeo.llm.words import word_parts
from chronogeo.session import durable, durable_table, ship_package

SHINGLE = 3
PERCENT = 90
SPARE = 2
#: Each class of sizes begins at so many times the one before.
CLASS_RATIO = 1.25
LEAF_BITS, FAN = 256, 8
CROWD_SETS, CROWD_ELEMENTS = 2048, 4_000_000
#: Digests a task remembers, so as to name the segments of equal sets once.
SEEN = 1_000_000
#: Trees cut into chunks are broadcast up to this count, and else joined by shuffle.
MAX_BROADCAST_TREES = 100_000
PAIRS_AT_ONCE = 1 << 16


def elements(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text; of all its words if they are fewer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found, words = [], []
    for part in word_parts(data.lower()):  # bytes.lower() touches ASCII only
        words += part
        n = len(words)
        if n < shingle:
            continue
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lengths + 1) - lengths - 1
        first, last = starts[: n - shingle + 1].tolist(), (starts + lengths)[shingle - 1 :].tolist()
        found.append(np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(first, last)), np.uint64, len(first))))
        words = words[n - shingle + 1 :]  # they begin shingles that go on in the next part
    if not found:
        return np.array([digest(b" ".join(words))] if words else [], np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def set_digest(own: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes())


def size_classes(size: int, percent: int = PERCENT, ratio: float = CLASS_RATIO) -> list[tuple[int, int]]:
    """(class, most elements in which two linked sets of the class differ) of each class that a set of a size belongs to.

    A class holds the pairs whose smaller set has a size of its range.
    """
    out, k, low = [], 0, 1
    while low <= size:
        high = max(low, int(low * ratio) - 1)
        most = high * 100 // percent
        apart = (high + most) * (100 - percent) // (100 + percent)
        if size <= most and apart:
            out.append((k, apart))
        k, low = k + 1, high + 1
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def segment_keys(own: np.ndarray, percent: int = PERCENT, ratio: float = CLASS_RATIO, classes: list | None = None) -> np.ndarray:
    """Hashes that name the segments of a set."""
    out = [np.zeros(0, np.uint64)]
    mixed = _mixed(own) if len(own) else own
    for k, apart in size_classes(len(own), percent, ratio) if classes is None else classes:
        n = apart + 1 + SPARE
        segment = (own % np.uint64(n)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        ranked = segment[order]
        begins = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sums = np.zeros(n, np.uint64)
        sums[ranked[begins]] = np.add.reduceat(mixed[order], begins)
        named = np.arange(n) if n - len(begins) > SPARE else ranked[begins]
        out.append(_mixed(sums[named] + _mixed(named.astype(np.uint64) + (np.uint64(k) << np.uint64(32)) + np.uint64(1))))
    return np.concatenate(out)


def _set_batches(batches: Iterator[pa.RecordBatch], shingle: int, percent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of documents (n, digest, id) and of segment keys (key, id), the latter once for equal sets of a task."""
    seen: set[bytes] = set()
    known: dict[int, list] = {}
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        sizes, digests, ids, keys, counts = [], [], [], [], []
        for t in texts:
            own = elements(t.as_py() or b"", shingle)
            digest = set_digest(own) if len(own) else None
            sizes.append(len(own))
            digests.append(digest)
            ids.append(int.from_bytes(digest[:8], "little", signed=True) if digest else None)
            if digest and digest not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
                if len(own) not in known:
                    known[len(own)] = size_classes(len(own), percent)
                keys.append(segment_keys(own, percent, classes=known[len(own)]))
                counts.append((ids[-1], len(keys[-1])))
        fill = lambda rows, **columns: pa.RecordBatch.from_pydict({f.name: columns.get(f.name, pa.nulls(rows, f.type)) for f in schema}, schema=schema)
        yield fill(batch.num_rows, doc_id=batch.column(0), n=pa.array(sizes, pa.int64()), digest=pa.array(digests, pa.binary()), id=pa.array(ids, pa.int64()))
        if keys:
            every = np.concatenate(keys).view(np.int64)
            of = np.repeat(np.array([i for i, _ in counts], np.int64), [n for _, n in counts])
            for at in range(0, len(every), 500_000):
                part = slice(at, at + 500_000)
                yield fill(len(every[part]), key=pa.array(every[part]), id=pa.array(of[part]))


def _star_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each id of a run of equal keys with the first of the run."""
    key = first = None
    for batch in batches:
        keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        begins = np.flatnonzero(np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]]))
        heads = ids[begins] if len(begins) and begins[0] == 0 else np.concatenate([[first], ids[begins]])
        at = begins if len(begins) and begins[0] == 0 else np.concatenate([[0], begins])
        head = np.repeat(heads, np.diff(np.concatenate([at, [len(keys)]])))
        key, first = keys[-1], head[-1]
        other = head != ids
        pairs = np.unique(np.column_stack([head[other], ids[other]]), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int64)), pa.array(pairs[:, 1].astype(np.int64))], names=["a", "b"])


def links_of_tree(sets: list[np.ndarray], percent: int = PERCENT, fan: int = FAN) -> list[tuple[int, int]]:
    """Links among sets of sorted elements that join all that is linked, by a dual traversal."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if k == 2:
        x, y = int(sizes[0]), int(sizes[1])
        same = len(np.intersect1d(sets[0], sets[1], assume_unique=True)) if min(x, y) * 100 >= percent * max(x, y) else 0
        return [(0, 1)] if 100 * same >= percent * (x + y - same) else []
    order = sorted(range(k), key=lambda i: (tuple(sets[i][:2].tolist()), len(sets[i])))
    sizes = sizes[order]
    every = np.concatenate([sets[i] for i in order])
    _, local = np.unique(every, return_inverse=True)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    # Bitmaps of the leaves, and how many elements of each share a bit with another.
    n_bits = LEAF_BITS
    while n_bits < min(4 * int(sizes.max()), 1 << 14):
        n_bits *= 2
    bit = (every % np.uint64(n_bits)).astype(np.int64)
    bits = np.zeros((k, n_bits // 64), np.uint64)
    np.bitwise_or.at(bits, (np.repeat(np.arange(k), sizes), bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    levels = [(bits, sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), sizes, sizes)]
    while len(levels[-1][0]) > 1:
        b, extra, low, high = levels[-1]
        at = np.arange(0, len(b), fan)
        levels.append((np.bitwise_or.reduceat(b, at), np.maximum.reduceat(extra, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
    label = np.arange(k)
    mark = np.zeros(int(local.max()) + 1 if len(local) else 1, bool)
    out: list[tuple[int, int]] = []

    def possible(h: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of nodes of a level can hold a link."""
        b, extra, low, high = levels[h]
        live = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        i, j, at = i[live], j[live], np.flatnonzero(live)
        need = np.maximum(-(-percent * (low[i] + low[j]) // (100 + percent)), -(-percent * np.maximum(low[i], low[j]) // 100))
        step = max(1, (1 << 22) // b.shape[1])
        overlap = np.concatenate([np.zeros(0, np.int64), *[np.bitwise_count(b[i[s : s + step]] & b[j[s : s + step]]).sum(axis=1, dtype=np.int64) for s in range(0, len(i), step)]])
        return at[(overlap + np.minimum(extra[i], extra[j]) >= need) | (i == j)]

    def below(h: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children of pairs of nodes of a level, each once."""
        n = len(levels[h - 1][0])
        step = np.arange(fan)
        x = np.repeat(i * fan, fan * fan) + np.tile(np.repeat(step, fan), len(i))
        y = np.repeat(j * fan, fan * fan) + np.tile(step, len(j) * fan)
        keep = (x < n) & (y < n) & ((x <= y) if h > 1 else (x < y))
        return x[keep], y[keep]

    def compare(x: int, others: np.ndarray) -> None:
        """Compares a set with others exactly; those that link are of its class from now on."""
        mark[local[begins[x] : ends[x]]] = True
        size = sizes[others]
        at = np.repeat(begins[others] - np.cumsum(size) + size, size) + np.arange(size.sum())
        same = np.add.reduceat(mark[local[at]], np.cumsum(size) - size, dtype=np.int64)
        mark[local[begins[x] : ends[x]]] = False
        for y in others[100 * same >= percent * (sizes[x] + size - same)].tolist():
            if label[x] != label[y]:
                out.append((order[x], order[y]))
                label[label == label[y]] = label[x]

    def descend(h: int, i: np.ndarray, j: np.ndarray) -> None:
        if h == 0:
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            live = possible(0, i, j)
            i, j = i[live], j[live]
            by = np.argsort(i, kind="stable")
            i, j = i[by], j[by]
            cuts = np.flatnonzero(np.concatenate([np.ones(min(1, len(i)), bool), i[1:] != i[:-1]])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(i)]):
                others = j[a:b]
                others = others[label[others] != label[i[a]]]
                for s in range(0, len(others), 256):  # what one part links, the next need not compare
                    part = others[s : s + 256]
                    part = part[label[part] != label[i[a]]]
                    if len(part):
                        compare(int(i[a]), part)
            return
        for s in range(0, len(i), PAIRS_AT_ONCE // (fan * fan)):
            x, y = i[s : s + PAIRS_AT_ONCE // (fan * fan)], j[s : s + PAIRS_AT_ONCE // (fan * fan)]
            live = possible(h, x, y)
            if len(live):
                descend(h - 1, *below(h, x[live], y[live]))

    descend(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))
    return out


def _tree_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal trees (and chunks): columns are tree, i, j, digest, elements."""
    held: dict[bytes, np.ndarray] = {}
    tree = None

    def links():
        digests = list(held)
        found = links_of_tree(list(held.values()), percent) if len(held) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([digests[x] for x, _ in found], pa.binary()), pa.array([digests[y] for _, y in found], pa.binary())], names=["a", "b"])

    for batch in batches:
        trees = list(zip(*(c.to_pylist() for c in batch.columns[:3])))
        lists = batch.column(4)
        values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        for r, digest in enumerate(batch.column(3).to_pylist()):
            if trees[r] != tree:
                yield from links()
                held, tree = {}, trees[r]
            held[digest] = values[offsets[r] : offsets[r + 1]].copy()
    yield from links()


def _members(docs: DataFrame, text: str, doc_id: str, rows: DataFrame, trees: DataFrame, shingle: int) -> DataFrame:
    """tree, digest, elements of every set that shares a segment, once each."""
    heads = rows.join(trees, F.col("id") == F.col("node")).groupBy("digest", F.col("label").alias("tree")).agg(F.min("doc_id").alias("r_id"))
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(heads, F.col("doc_id").eqNullSafe(F.col("r_id")))

    def run(batches):
        from chronogeo.llm.signature_trees import elements, set_digest

        for batch in batches:
            for i in range(batch.num_rows):  # one set at a time: they may be long
                own = elements(batch.column(2)[i].cast(pa.binary()).as_py() or b"", shingle)
                if len(own) and set_digest(own) == batch.column(1)[i].as_py():  # else another row that repeats the id
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own.view(np.int64)))], names=["tree", "digest", "elements"])

    return texts.select("tree", "digest", "text").mapInArrow(run, "tree bigint, digest binary, elements array<bigint>")


def _in_chunks(members: DataFrame, sets: int, most: int) -> DataFrame:
    """Members of crowded trees once for each pair of chunks (i, j) they belong to, all others with i = j = 0."""
    sums = members.groupBy(F.col("tree").alias("c_tree")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("elements")).alias("w"))
    crowded = durable(sums.select("c_tree", F.greatest(F.ceil(F.col("n") / sets), F.ceil(F.col("w") / most)).cast("int").alias("chunks")).filter("chunks > 1"))
    n = crowded.count()
    if not n:
        return members.select("tree", F.lit(0).alias("i"), F.lit(0).alias("j"), "digest", "elements")
    crowded = F.broadcast(crowded) if n <= MAX_BROADCAST_TREES else crowded
    rows = members.join(crowded, F.col("tree") == F.col("c_tree"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.filter("chunks = 1 OR own <> other")  # two chunks together hold the pairs within each
    return rows.select("tree", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "digest", "elements")


def classes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT, crowd_sets: int = CROWD_SETS, crowd_elements: int = CROWD_ELEMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the class), label (digest of a set of the class, null for an empty set), one row per input row."""
    spark = docs.sparkSession
    ship_package(spark)
    read = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ddl = f"doc_id {read.schema['doc_id'].dataType.simpleString()}, n bigint, digest binary, id bigint, key bigint"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def named(batches):
        from chronogeo.llm.signature_trees import _set_batches

        return _set_batches(batches, shingle, percent, schema)

    def star(batches):
        from chronogeo.llm.signature_trees import _star_batches

        return _star_batches(batches)

    def traverse(batches):
        from chronogeo.llm.signature_trees import _tree_batches

        return _tree_batches(batches, percent)

    read = durable_table(read.mapInArrow(named, ddl))
    rows = read.filter("key IS NULL").select("doc_id", "n", "digest", "id")
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = read.filter("key IS NOT NULL").select("key", "id").repartition(parts, "key").sortWithinPartitions("key", "id")
    trees = component_labels(keys.mapInArrow(star, "a bigint, b bigint").distinct())
    members = durable_table(_members(docs, text, doc_id, rows, trees, shingle))
    dealt = _in_chunks(members, crowd_sets, crowd_elements).repartition(parts, "tree", "i", "j").sortWithinPartitions("tree", "i", "j")
    labels = component_labels(dealt.mapInArrow(traverse, "a binary, b binary").distinct()).withColumnRenamed("node", "digest")
    firsts = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"))
    # Tables of their own, so that Spark can split a class that holds very many sets.
    named_sets = durable(firsts.join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest")))
    least = durable(named_sets.groupBy("label").agg(F.min("first").alias("component_id")))
    full = rows.filter("digest IS NOT NULL").join(named_sets.join(least, "label").select("digest", "label", "component_id"), "digest")
    empty = rows.filter("digest IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("label"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "label").unionByName(empty)


def joined(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return classes(docs, **options).drop("label")
