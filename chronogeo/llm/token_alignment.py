"""Alignment of two tokenizers' tokens, with corpus-wide link counts.

A text with a blank before it is encoded by a byte-level vocabulary (A) and by
a piece vocabulary (B). Each of its bytes gets a label: no token ends there, a
token of A, a token of B, or one of both. A regular expression reads the label
string in spans up to each both-label; a span's counts of labels say how many
tokens of A and of B are its group.

Texts are cut into units at places where both encodings end a token whatever
stands around it (before white space that follows another character, where the
white space is a blank or part of no piece of B), so groups never cross units.
Units are labelled in batches, each distinct one once, and remembered by the
Python worker up to a fixed size.

Links are pairs of tokens of one group. Documents are dealt with in chunks of
about ``CHUNK_BYTES`` of text. A chunk counts its distinct id pairs before
anything is shuffled, so that no pair has more rows than there are chunks; the
counts meet by pair, go back to the chunks, and each document's sums are read
from its chunk's table. The greatest count of each A id is a table of no more
rows than A has ids, which is broadcast.

Defined results: texts that are null, empty or not given back by both
encodings (U+2581 stands for a blank in B) have no tokens: zeros and an empty
digest; special strings are plain text; repeated rows and repeated ids count
as documents of their own; ties for the greatest count are all greatest; an
empty table gives an empty result; columns other than the id and the text are
ignored, whatever their names. Texts are read in parts of ``PART_CHARS``, so
that a long one never lies in memory token by token; only a stretch without a
place to cut is encoded as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chronogeo.llm.token_counts import SPACE
from chronogeo.session import durable_table, ship_package

VOCABULARY_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES = 8 << 20
PART_CHARS = 1 << 20
#: Bytes of units, with their groups, that a worker remembers.
REMEMBERED = 96 << 20
#: A group with more links counts them, instead of listing them.
WIDE = 4096
NONE, ENDS_A, ENDS_B, BOTH = b"0123"
SPAN = re.compile(b"[^%c]*%c" % (BOTH, BOTH))
_LOADED: dict[tuple[str, str], "Aligner"] = {}


class _Rows:
    """A growing array."""

    def __init__(self, width: int | None = None):
        self.data, self.size = np.zeros((1024, width) if width else 1024, np.int64), 0

    def extend(self, values) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            grown = np.zeros((max(end, 2 * len(self.data)), *self.data.shape[1:]), np.int64)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        if len(values):
            self.data[self.size : end] = values
        self.size = end


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def links_of_group(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed id pairs of a group, and how many occurrences each links."""
    ua, na = np.unique(a, return_counts=True)
    ub, nb = np.unique(b, return_counts=True)
    return (ua[:, None] << 32 | ub[None, :]).ravel(), (na[:, None] * nb[None, :]).ravel()


class Aligner:
    """Both vocabularies, and the groups of the units seen so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        table = byte_table()
        self.bytes_a = {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search(r"[^▁]▁|\n", p) for p in pieces):
            raise ValueError("a piece holds a line end, or a blank after another character")
        cut = " " + "".join(c for c in "\t\n\x0b\x0c\r" if not any(c in p for p in pieces))
        odd = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c) and c not in cut)
        self.unit = re.compile(f"[{SPACE}]*[^{SPACE}]+(?:[{odd}][{SPACE}]*[^{SPACE}]*)*|[{SPACE}]+")
        self.place = re.compile(f"(?<=[^{SPACE}])[{cut}]")
        self.blank_end = re.compile(f"[{SPACE}]\\Z")
        self.size_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)], np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)
        texts = lambda n, after: np.array([f"{i}{after}" for i in range(n)], object)
        self.text_a, self.bar_a = texts(len(self.size_a), ","), texts(len(self.size_a), "|")
        self.text_b, self.close_b, self.end_b = (texts(len(self.size_b), after) for after in (",", ";", ""))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.shown: list[str] = []
        self.held = 0
        self.stats = _Rows(6)  # tokens of A (-1: not given back), of B, groups, links, offset and number of pairs
        self.pairs, self.times = _Rows(), _Rows()

    def encode(self, units: list[str]) -> tuple[list[int], list[int]]:
        """Ids of A and B of units in a row; a unit that ends in white space comes alone."""
        text = "".join(units)
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode("\n" + text)[2:]  # after the blank put first, and the line end

    def learn(self, units: list[str]) -> None:
        """Labels new units, and keeps their groups; units that B or A don't give back are kept as such."""
        a, b = map(np.array, self.encode(units), (np.int64, np.int64))
        raw = [u.encode() for u in units]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        end_a, end_b, end = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), np.cumsum(size)
        whole = b"".join(raw)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != whole or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != whole:
            if len(units) == 1:
                return self._keep(units, np.array([[-1, 0, 0, 0, 0, 0]]), np.zeros(0, np.int64), np.zeros(0, np.int64), [""])
            for part in (units[: len(units) // 2], units[len(units) // 2 :]):
                self.learn(part)
            return None
        labels = np.full(len(whole), NONE, np.uint8)
        labels[end_a - 1] += ENDS_A - NONE
        labels[end_b - 1] += ENDS_B - NONE
        closes = np.cumsum(np.fromiter(map(len, SPAN.findall(labels.tobytes())), np.int64)) - 1  # where groups close
        last_a, last_b = (np.cumsum(labels >> i & 1, dtype=np.int64)[closes] for i in (0, 1))
        n, m = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        last = np.searchsorted(closes, end - 1)  # the last group of each unit
        groups = np.diff(last, prepend=-1)
        # Id texts with what follows each: a comma, a bar, a semicolon, or nothing at a unit's end.
        shown = np.empty(len(a) + len(b), object)
        place_a = np.arange(len(a)) + np.repeat(last_b - m, n)
        place_b = np.arange(len(b)) + np.repeat(last_a, m)
        shown[place_a] = self.text_a[a]
        shown[place_b] = self.text_b[b]
        shown[place_a[last_a - 1]] = self.bar_a[a[last_a - 1]]
        shown[place_b[last_b - 1]] = self.close_b[b[last_b - 1]]
        stop = (last_a + last_b)[last]
        shown[stop - 1] = self.end_b[b[last_b[last] - 1]]
        shown, stops = shown.tolist(), stop.tolist()
        texts = ["".join(shown[x:y]) for x, y in zip([0, *stops], stops)]
        links = n * m
        if int(links.max()) <= WIDE:
            of = np.repeat(np.arange(len(n)), links)
            k = np.arange(len(of)) - np.repeat(np.cumsum(links) - links, links)
            pairs = a[(last_a - n)[of] + k // m[of]] << 32 | b[(last_b - m)[of] + k % m[of]]
            times, held = np.ones(len(pairs), np.int64), links
        else:  # repeated pairs of a wide group are counted, not listed
            found = [links_of_group(a[x - i : x], b[y - j : y]) for x, y, i, j in zip(last_a.tolist(), last_b.tolist(), n.tolist(), m.tolist())]
            pairs, times, held = np.concatenate([p for p, _ in found]), np.concatenate([t for _, t in found]), np.array([len(p) for p, _ in found])
        per = lambda v: np.diff(np.cumsum(v)[last], prepend=0)
        held = per(held)
        return self._keep(units, np.column_stack([per(n), per(m), groups, per(links), np.cumsum(held) - held, held]), pairs, times, texts)

    def _keep(self, units: list[str], stats: np.ndarray, pairs: np.ndarray, times: np.ndarray, texts: list[str]) -> None:
        stats[:, 4] += self.pairs.size
        self.known.update(zip(units, range(len(self.shown), len(self.shown) + len(units))))
        self.shown += texts
        self.stats.extend(stats)
        self.pairs.extend(pairs)
        self.times.extend(times)
        self.held += 250 * len(units) + sum(map(len, units)) + sum(map(len, texts)) + 16 * len(pairs)

    def parts(self, text: str, size: int = PART_CHARS) -> Iterator[list[str]]:
        """Units of a text with a blank before it, part by part."""
        text, at = " " + text, 0
        while at < len(text):
            cut = self.place.search(text, at + size) if len(text) > at + size else None
            end = cut.start() if cut else len(text)
            yield self.unit.findall(text, at, end)
            at = end

    def read(self, units: list[list[str]]) -> None:
        """Learns what is new in lists of units."""
        if self.held > REMEMBERED:
            self.forget()
        new = list(set().union(*units).difference(self.known))
        open_ended = [u for u in new if self.blank_end.search(u)]
        for u in open_ended:
            self.learn([u])
        new = list(set(new).difference(open_ended)) if open_ended else new
        for at in range(0, len(new), 4096):
            self.learn(new[at : at + 4096])

    def numbers(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, str] | None:
        """Sums (tokens of A and B, groups, links), distinct pairs, their times and the groups' text of known units; None if not given back."""
        n = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        if (self.stats.data[n, 0] < 0).any():
            return None
        own, count = np.unique(n, return_counts=True)
        begin, size = self.stats.data[own, 4], self.stats.data[own, 5]
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        pairs, times = merged(self.pairs.data[at], self.times.data[at] * np.repeat(count, size))
        return (self.stats.data[own, :4] * count[:, None]).sum(axis=0), pairs, times, ";".join(map(self.shown.__getitem__, n.tolist()))

    def text(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, str] | None:
        """numbers() of a text of any length."""
        sums, pairs, times, shown = np.zeros(4, np.int64), [], [], []
        for units in self.parts(text):
            self.read([units])
            got = self.numbers(units)
            if got is None:
                return None
            sums += got[0]
            pairs.append(got[1])
            times.append(got[2])
            shown.append(got[3])
        return sums, *merged(np.concatenate(pairs), np.concatenate(times)), ";".join(shown)


def merged(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def load(path_a: str, path_b: str) -> Aligner:
    """The tables of two vocabularies, made once per worker."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


NO_TOKENS = (np.zeros(4, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), "")


def aligned_texts(v: Aligner, texts: list[str | None]) -> Iterator[tuple]:
    """numbers() of each text, zeros for those without tokens; short texts are read together."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < PART_CHARS:
            size += len(texts[end] or "")
            end += 1
        units = [next(v.parts(t), []) if t and len(t) < PART_CHARS else [] for t in texts[at:end]]
        v.read(units)
        short = [v.numbers(u) or NO_TOKENS if u else None for u in units]  # before a long text makes the worker forget
        for t, got in zip(texts[at:end], short):
            yield got or (v.text(t) if t and len(t) >= PART_CHARS else None) or NO_TOKENS
        at = end


def _chunk_batches(chunk: int, ids: list, rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A chunk as rows of documents (positions in the chunk's sorted pairs, and times) and rows of pairs (documents that hold them)."""
    every = np.concatenate([r[1] for r in rows])
    pairs, where = np.unique(every, return_inverse=True)
    ends = np.cumsum([len(r[1]) for r in rows])
    held = np.bincount(where, minlength=len(pairs))
    own = lambda rows_, **columns: pa.RecordBatch.from_pydict({f.name: columns.get(f.name, pa.nulls(rows_, f.type)) for f in schema}, schema=schema)
    at, step = 0, 0
    for k in range(len(rows)):
        step += len(rows[k][3]) + 12 * len(rows[k][1])
        if k + 1 < len(rows) and step < 4 << 20:
            continue
        part = rows[at : k + 1]
        begin = ends[at] - len(rows[at][1])
        offsets = pa.array(np.concatenate([[0], ends[at : k + 1] - begin]).astype(np.int32))
        sums = np.array([r[0] for r in part], np.int64).reshape(-1, 4)
        yield own(
            len(part), chunk=pa.array(np.full(len(part), chunk)), doc_id=pa.array(ids[at : k + 1], schema.field("doc_id").type),
            **{name: pa.array(sums[:, i]) for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            groups=pa.array([r[3] for r in part], schema.field("groups").type),
            places=pa.ListArray.from_arrays(offsets, pa.array(where[begin : ends[k]].astype(np.int32))),
            times=pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[2] for r in part]))),
        )
        at, step = k + 1, 0
    for k in range(0, len(pairs), 200_000):
        keys, docs = pairs[k : k + 200_000], held[k : k + 200_000]
        yield own(len(keys), chunk=pa.array(np.full(len(keys), chunk)), pair=pa.array(keys), docs=pa.array(docs))


def _coded_batches(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, task: int, chunk_bytes: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    v, chunk = load(path_a, path_b), task << 32
    ids, rows, size = [], [], 0
    for batch in batches:
        texts = batch.column(1)
        at = 0
        while at < batch.num_rows:
            end, held = at, 0  # no more rows at once than a part's length, as Python text
            while end < batch.num_rows and held < PART_CHARS:
                held += len(texts[end].as_buffer() or b"")
                end += 1
            for i, got in zip(batch.column(0).slice(at, end - at).to_pylist(), aligned_texts(v, texts.slice(at, end - at).to_pylist())):
                ids.append(i)
                rows.append(got)
                size += len(got[3]) // 2 + 8
            at = end
            if size >= chunk_bytes:
                yield from _chunk_batches(chunk, ids, rows, schema)
                chunk, ids, rows, size = chunk + 1, [], [], 0
    if rows:
        yield from _chunk_batches(chunk, ids, rows, schema)


def _coded(docs: DataFrame, text: str, doc_id: str, path_a: str | None, path_b: str | None, chunk_bytes: int) -> DataFrame:
    """Rows of documents and rows of pairs of each chunk."""
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(MODEL_B)
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ddl = f"chunk bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, places array<int>, times array<bigint>, pair bigint, docs bigint"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        from pyspark import TaskContext

        from chronogeo.llm.token_alignment import _coded_batches

        return _coded_batches(batches, path_a, path_b, TaskContext.get().partitionId(), chunk_bytes, schema)

    return rows.mapInArrow(run, ddl)


def grouped(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (as ``a1,a2|b1;a3|b2,b3``, empty without tokens), one row per input row."""
    return _coded(docs, text, doc_id, path_a, path_b, CHUNK_BYTES).filter("places IS NOT NULL").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of a chunk with n_best and count_sum; the chunk's pairs in order are what the places point to."""
    order = np.argsort(pairs["pair"].to_numpy())
    count, best = pairs["n"].to_numpy()[order], pairs["best"].to_numpy()[order].astype(np.int64)
    places, times = docs["places"].combine_chunks(), docs["times"].combine_chunks()
    at, by, lengths = places.flatten().to_numpy(), times.flatten().to_numpy(), places.value_lengths().to_numpy()
    total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v * by)])[np.concatenate([[0], np.cumsum(lengths)])])
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(total(best[at] if len(at) else by), pa.int64())).append_column("count_sum", pa.array(total(count[at] if len(at) else by), pa.int64()))
    return out.append_column("groups_sha256", docs["groups_sha256"])


def linked(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", path_a: str | None = None, path_b: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row per input row."""
    coded = _coded(docs, text, doc_id, path_a, path_b, chunk_bytes)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    coded = durable_table(coded.withColumn("groups_sha256", digest).drop("groups"))
    pairs = coded.filter("pair IS NOT NULL").select("chunk", "pair", "docs")
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("n"))
    counts = durable_table(counts.withColumn("a", F.shiftright("pair", 32)))
    most = counts.groupBy(F.col("a").alias("m_a")).agg(F.max("n").alias("most"))  # no more rows than A has ids
    counts = counts.join(F.broadcast(most), F.col("a") == F.col("m_a")).select(F.col("pair").alias("c_pair"), "n", (F.col("n") == F.col("most")).alias("best"))
    told = pairs.join(counts, F.col("pair") == F.col("c_pair")).select(F.col("chunk").alias("t_chunk"), "pair", "n", "best")
    rows = coded.filter("places IS NOT NULL").drop("pair", "docs")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(left, right):
        from chronogeo.llm.token_alignment import _summed

        return _summed(left, right)

    return rows.groupBy("chunk").cogroup(told.groupBy("t_chunk")).applyInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
