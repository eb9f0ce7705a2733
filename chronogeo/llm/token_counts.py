"""Exact token counts of texts of any length, by overlap resynchronisation.

A huge text is encoded in overlapping chunks with offsets. Neighbouring encodings are spliced at a token boundary that both
have and that is proven stable: one between a character that is not white
space and one that is. The pre-tokeniser never crosses such a place and
decides what follows it from what follows it alone, so the tokens after it
are the same whatever came before; an added special token holds no white
space, so none crosses it either. If an overlap has no such place, it is made
wider and encoded again, at last reaching the end of the text.

Texts of less than a chunk are cut at all such places, and each distinct unit
between two of them is encoded once and remembered (``REMEMBERED`` at most, of
``UNIT_CHARS`` characters or fewer each).

Defined results: a null text counts as empty; nothing is truncated; special
strings in texts count as the library counts them by default; repeated rows
are each counted; an empty table gives an empty result; columns other than the
id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogeo.session import ship_package

VOCABULARY = "byte_bpe_50k.json"
CHUNK = 32_768
OVERLAP = 512
REMEMBERED = 500_000
UNIT_CHARS = 64
#: White space of the pre-tokeniser's pattern.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_LOADED: dict[str, object] = {}
_COUNTS: dict[int, dict[str, int]] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker, on one thread."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


def _starts(tk, text: str, begin: int, end: int) -> list[int]:
    """Offsets in the whole text at which the tokens of text[begin:end] start."""
    return [begin + a for a, _ in tk.encode(text[begin:end], add_special_tokens=False).offsets]


def _stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in " \t\n\r" and not text[at - 1].isspace()


def count_long(tk, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text that is encoded in overlapping chunks."""
    n, total, begin = len(text), 0, 0
    end = min(n, chunk)
    left = _starts(tk, text, begin, end)
    while end < n:
        wide, splice, right, stop = overlap, None, [], end
        while splice is None:
            start = max(begin + 1, end - wide)
            stop = min(n, max(end, start + chunk, end + wide))
            right = _starts(tk, text, start, stop)
            both = set(right)
            # The last character of the left chunk may be cut off from what follows it.
            splice = next((p for p in reversed(left) if start < p < end - 1 and p in both and _stable(text, p)), None)
            if splice is None:
                if stop == n and start == begin + 1:
                    break
                if start == begin + 1:  # the whole left chunk has no stable place: encode it with more of what follows
                    end = min(n, begin + 2 * (end - begin))
                    left = _starts(tk, text, begin, end)
                    if end == n:
                        break
                wide *= 2
        if splice is None:
            return total + len(_starts(tk, text, begin, n))
        total += sum(1 for p in left if p < splice)
        left = [p for p in right if p >= splice]
        begin, end = splice, stop
    return total + len(left)


def count_short(tk, texts: list[str]) -> list[int]:
    """Tokens of texts by their distinct units."""
    known = _COUNTS.setdefault(id(tk), {})
    units = [UNIT.findall(t) for t in texts]
    new = list(set().union(*units).difference(known))
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = list(set().union(*units))
    for at in range(0, len(new), 4096):
        part = new[at : at + 4096]
        known.update(zip(part, map(len, tk.encode_batch(part, add_special_tokens=False))))
    out = [sum(map(known.__getitem__, u)) for u in units]
    for u in new:
        if len(u) > UNIT_CHARS:
            del known[u]
    return out


def count_tokens(tk, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    out = [0] * len(texts)
    short = [i for i, t in enumerate(texts) if len(t) <= chunk]
    for at in range(0, len(short), 512):
        part = short[at : at + 512]
        for i, n in zip(part, count_short(tk, [texts[i] for i in part])):
            out[i] = n
    for i, t in enumerate(texts):
        if len(t) > chunk:
            out[i] = count_long(tk, t, chunk, overlap)
    return out


def n_tokens(text: Column, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    def udf(texts: pa.Array) -> pa.Array:
        from chronogeo.llm import token_counts as own

        return pa.array(own.count_tokens(own.tokenizer(path), [t or "" for t in texts.to_pylist()], chunk, overlap), pa.int64())

    return F.arrow_udf(udf, "bigint")(text)


def counted(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", path: str | None = None, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, one row per input row."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(F.col(text), path, chunk, overlap).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
