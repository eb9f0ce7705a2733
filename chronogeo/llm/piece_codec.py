"""SentencePiece BPE encoding and decoding with a suffix array.

A batch's texts are cut into units where no piece crosses (before a run of
blanks, and around control characters that are part of no piece). The
distinct units are joined to one text and its suffixes sorted; every piece is
found by binary search for its range of suffixes, which gives edges (start,
end, piece); edges are sorted by position and relaxed.

Relaxing: the encoding of each prefix of a unit ends in exactly one piece, the
one whose pair with the last piece of the prefix before it is stable, i.e. no
merge of the merge order would have crossed their boundary. So an edge relaxes
its end if the pair of (last piece at its start, its own piece) is stable; the
walk back from a unit's end gives its pieces. The result is that of merging by
score, as the library does it.

Defined results: a null text counts as empty and has no pieces; U+2581 in a
text is encoded as the blank it stands for, as in the library, so decoding
gives a blank for it and ``exact`` is false; all else comes back exactly;
repeated rows are each encoded; an empty table gives an empty result; of other
columns those named in ``keep`` are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogeo.session import ship_package

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
KEY = 16
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 12 << 20
FREE = np.iinfo(np.int32).max
_LOADED: dict[str, "Pieces"] = {}


@dataclass
class Pieces:
    """A vocabulary as tables: bytes of each piece, merge ranks, last merges, and stable pairs seen so far."""

    text: list[bytes]
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    byte_ids: np.ndarray
    usable: np.ndarray
    sizes: np.ndarray
    unit: re.Pattern
    seen_keys: np.ndarray = field(default_factory=lambda: np.full(1 << 20, -1, np.int64))
    seen_ok: np.ndarray = field(default_factory=lambda: np.zeros(1 << 20, bool))


def _merged(symbols: list[int], ids: dict[bytes, int], text: list[bytes], rank: list[int]) -> tuple[list[int], tuple[int, int] | None]:
    """Merges by rank, leftmost first; the symbols left, and the last merge."""
    symbols, last = list(symbols), None
    while True:
        best = None
        for i in range(len(symbols) - 1):
            k = ids.get(text[symbols[i]] + text[symbols[i + 1]])
            if k is not None and (best is None or rank[k] < best[0]):
                best = (rank[k], i, k)
        if best is None:
            return symbols, last
        _, i, k = best
        last = (symbols[i], symbols[i + 1])
        symbols[i : i + 2] = [k]


def load(path: str) -> Pieces:
    """The tables of a model file, made once per worker."""
    if path in _LOADED:
        return _LOADED[path]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    text, ids, byte_ids = [b""] * n, {}, np.full(256, -1, np.int32)
    for i in range(n):
        if sp.is_byte(i):
            value = int(sp.id_to_piece(i)[3:-1], 16)
            text[i], byte_ids[value] = bytes([value]), i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            text[i] = sp.id_to_piece(i).replace(BLANK, " ").encode()
            ids[text[i]] = i
    if any(re.search(rb"\x00|[^ ] ", t) for t in ids):
        raise ValueError("a piece holds U+0000, or a blank after another character")
    lone = b"".join(b"\\x%02x" % b for b in range(32) if not any(b in t for t in ids))
    unit = re.compile(rb" *[^ %b]+| +|[%b]" % (lone, lone))
    order = sorted(ids.values(), key=lambda i: (-sp.get_score(i), i))
    rank = [-1] * n
    for r, i in enumerate(order):
        rank[i] = r
    atoms = {t: i for t, i in ids.items() if len(t.decode()) == 1}
    merges = {t: i for t, i in ids.items() if t not in atoms}
    left, right, usable = np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.zeros(n, bool)
    usable[list(atoms.values())] = True
    for t, i in merges.items():
        chars = [atoms.get(c.encode()) for c in t.decode()]
        if None in chars:
            continue
        symbols, last = _merged(chars, merges, text, rank)
        if symbols == [i]:
            usable[i], (left[i], right[i]) = True, last
    pairs = {}
    for t, i in merges.items():
        chars = t.decode()
        for k in range(1, len(chars)):
            a, b = ids.get(chars[:k].encode()), ids.get(chars[k:].encode())
            if a is not None and b is not None:
                pairs[a * n + b] = rank[i]
    keys = np.array(sorted(pairs), np.int64)
    ranks = np.array(rank, np.int32)
    ranks[list(atoms.values())] = -1
    _LOADED[path] = Pieces(text, ranks, left, right, keys, np.array([pairs[k] for k in keys.tolist()], np.int32), byte_ids, usable, np.array([len(t) for t in text], np.int32), unit)
    return _LOADED[path]


def stable_pairs(v: Pieces, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pieces a and b stay apart, told by undoing their merges from the last on.

    Before each undone merge, the symbols at the boundary must not have a merge of their own that
    comes first; of equal merges the left one comes first.
    """
    n = len(v.rank)
    out = np.ones(len(a), bool)
    live = np.arange(len(a))
    l, r, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), FREE, np.int32)
    while len(live):
        key = l * n + r
        at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
        crossing = np.where(v.pair_keys[at] == key, v.pair_ranks[at], FREE) < limit
        out[live[crossing]] = False
        rl, rr = v.rank[l], v.rank[r]
        go = ~crossing & ((rl >= 0) | (rr >= 0))
        live, l, r, rl, rr = live[go], l[go], r[go], rl[go], rr[go]
        undo_left = rl > rr
        limit = np.where(undo_left, rl, rr + 1).astype(np.int32)
        l, r = np.where(undo_left, v.right[l], l), np.where(undo_left, r, v.left[r])
    return out


def _stable(v: Pieces, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = a.astype(np.int64) * len(v.rank) + b
    slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
    miss = v.seen_keys[slot] != key
    out = v.seen_ok[slot]
    if miss.any():
        keys, back = np.unique(key[miss], return_inverse=True)
        ok = stable_pairs(v, keys // len(v.rank), keys % len(v.rank))
        out[miss] = ok[back]
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        v.seen_keys[slots] = keys
        hit = v.seen_keys[slots] == keys
        v.seen_ok[slots[hit]] = ok[hit]
    return out


def _edges(v: Pieces, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, piece) of every occurrence of a usable piece, and of bytes of characters without a piece."""
    padded = np.concatenate([data, np.zeros(KEY, np.uint8)])
    starts = np.flatnonzero((data != 0xFF) & ((data & 0xC0) != 0x80)).astype(np.int32)  # a text has fewer bytes than 2^31
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, KEY)[starts])
    words = keys.view(">u8").astype(np.uint64)
    order = np.lexsort((words[:, 1], words[:, 0]))
    suffixes, at = keys[order].view(f"S{KEY}").ravel(), starts[order]
    del keys, words, order
    pieces = np.flatnonzero(v.usable).astype(np.int32)
    heads = [v.text[i][:KEY] for i in pieces.tolist()]
    low = np.searchsorted(suffixes, np.array(heads, f"S{KEY}"), "left")
    high = np.searchsorted(suffixes, np.array([h + b"\xff" * (KEY - len(h)) for h in heads], f"S{KEY}"), "right")
    counts = np.maximum(high - low, 0)
    of = np.repeat(pieces, counts)
    where = at[np.repeat((low - np.cumsum(counts) + counts).astype(np.int32), counts) + np.arange(counts.sum(), dtype=np.int32)]
    long = np.flatnonzero(v.sizes[of] > KEY)
    if len(long):
        fits = np.array([padded[p + KEY : p + v.sizes[i]].tobytes() == v.text[i][KEY:] for p, i in zip(where[long].tolist(), of[long].tolist())], bool)
        drop = long[~fits]
        where, of = np.delete(where, drop), np.delete(of, drop)
    covered = np.zeros(len(data), bool)
    covered[where[v.rank[of] < 0]] = True
    bare = starts[~covered[starts]]
    if len(bare):
        b = data[bare]
        sizes = 1 + (b >= 0xC0).astype(np.int64) + (b >= 0xE0) + (b >= 0xF0)
        extra = np.repeat(bare - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        where, of = np.concatenate([where, extra.astype(np.int32)]), np.concatenate([of, v.byte_ids[data[extra]]])
    return where, of


def _edge_order(depth: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Edges by depth, then end, then longest first; one packed key where it fits 63 bits."""
    if not len(depth) or (int(depth.max()) < 1 << 23 and int(end.max()) < 1 << 35 and int(size.max()) < 32):
        key = depth.astype(np.int64) << 40
        key |= end.astype(np.int64) << 5
        key |= 31 - size
        return np.argsort(key)
    return np.lexsort((-size, end, depth))


def _encode_units(v: Pieces, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all units in a row, and how many each has."""
    data = np.frombuffer(b"\xff".join(units) + b"\xff", np.uint8)
    sizes = np.array([len(u) for u in units], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    where, of = _edges(v, data)
    first = begin[np.searchsorted(begin, where, "right") - 1].astype(np.int32)
    end = where + v.sizes[of]
    depth = end - first
    order = _edge_order(depth, end, v.sizes[of])
    where, of, end, depth, first = where[order], of[order], end[order], depth[order], first[order]
    del order
    groups = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
    group_sizes = np.diff(np.concatenate([groups, [len(end)]]))
    levels = np.searchsorted(depth[groups], np.arange(1, int(sizes.max()) + 2))
    last = np.full(len(data) + 1, -1, np.int32)
    for lo, hi in zip(levels[:-1].tolist(), levels[1:].tolist()):
        live, left, k = groups[lo:hi], group_sizes[lo:hi], 0
        while len(live):
            e = live + k
            before = last[where[e]]
            opening = where[e] == first[e]
            ok = opening.copy()
            known = np.flatnonzero(~opening & (before >= 0))
            if len(known):
                ok[known] = _stable(v, before[known], of[e[known]])
            last[end[e[ok]]] = of[e[ok]]
            k += 1
            go = ~ok & (left > k)
            live, left = live[go], left[go]
    at = begin + sizes
    steps, alive = [], np.arange(len(units))
    while len(alive):
        piece = last[at[alive]]
        if (piece < 0).any():
            raise ValueError(f"no encoding found for {units[alive[np.argmin(piece)]]!r}")
        steps.append((alive, piece))
        at[alive] -= v.sizes[piece]
        alive = alive[at[alive] > begin[alive]]
    counts = np.zeros(len(units), np.int64)
    for alive, _ in steps:
        counts[alive] += 1
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]), np.int32)
    for k, (alive, piece) in enumerate(steps):
        out[ends[alive] - 1 - k] = piece
    return out, counts


class _Numbers(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def encode_batch(v: Pieces, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts in a row, and how many each text has."""
    numbers = _Numbers()
    rows = []
    for t in texts:
        t = b" " + t.replace(BLANK.encode(), b" ") if t else b""
        rows.append(np.fromiter(map(numbers.__getitem__, v.unit.findall(t)), np.int32))
    units = list(numbers)
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    part, size = [], 0
    for u in [*units, None]:
        if part and (u is None or size + len(u) >= CHUNK_BYTES):
            a, b = _encode_units(v, part)
            ids.append(a)
            counts.append(b)
            part, size = [], 0
        if u is not None:
            part.append(u)
            size += len(u) + 1
    ids, counts = np.concatenate(ids), np.concatenate(counts)
    offsets = np.cumsum(counts) - counts
    lengths = np.array([len(r) for r in rows], np.int64)
    every = np.concatenate([np.zeros(0, np.int32), *rows])
    n = counts[every]
    total = np.concatenate([[0], np.cumsum(n)])
    out = ids[np.repeat(offsets[every] - total[:-1], n) + np.arange(total[-1])]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return out, np.diff(total[bounds])


def decode(v: Pieces, ids: list[int]) -> bytes:
    """UTF-8 bytes of the text of some pieces, without the blank that encoding puts first."""
    return b"".join(map(v.text.__getitem__, ids)).removeprefix(b" ")


def _coded_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = load(path)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        part, size, at = [], 0, 0
        for i in range(batch.num_rows + 1):
            t = (texts[i].as_py() or b"") if i < batch.num_rows else None
            if part and (t is None or size + len(t) > BATCH_BYTES):
                ids, counts = encode_batch(v, part)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                exact = [decode(v, ids[a:b].tolist()) == t for t, a, b in zip(part, offsets[:-1], offsets[1:])]
                own = batch.slice(at, len(part))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(counts), lists, pa.array(exact)], names=[*own.schema.names[:-1], "n_pieces", "pieces", "exact"])
                at, part, size = i, [], 0
            if t is not None:
                part.append(t)
                size += len(t)


def coded(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The kept columns, n_pieces, pieces (array of ids), exact (whether decoding gives the text back)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    ship_package(docs.sparkSession)

    def run(batches):
        from chronogeo.llm.piece_codec import _coded_batches

        return _coded_batches(batches, path)

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("text_to_encode"))
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kept}, n_pieces bigint, pieces array<int>, exact boolean")


def decoded(pieces: Column, path: str | None = None) -> Column:
    """The text of an array of piece ids; bytes that are no UTF-8 become U+FFFD; null for null."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)

    def udf(rows: pa.Array) -> pa.Array:
        from chronogeo.llm.piece_codec import decode, load

        v = load(path)
        return pa.array([None if r is None else decode(v, r).decode("utf-8", "replace") for r in rows.to_pylist()], pa.string())

    return F.arrow_udf(udf, "string")(pieces)
