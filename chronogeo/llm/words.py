"""Words of texts of any length, part by part."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Texts are split in parts of about so many bytes, so that the words of a very long one never lie in memory together.
PART = 1 << 20
_BLANK = re.compile(rb"[\t-\r ]")


def word_parts(data: bytes, size: int = PART) -> Iterator[list[bytes]]:
    """Lists of the words (between bytes 09-0D and 20) of a text, in order; a word is never cut."""
    at = 0
    while at < len(data):
        blank = _BLANK.search(data, at + size)
        end = blank.start() if blank else len(data)
        yield data[at:end].split()  # bytes.split() cuts at exactly these blanks
        at = end
