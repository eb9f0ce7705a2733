"""Text derivations as columns: hashes, names, links, sizes, HTML."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of an article that an excerpt leaves out, and tags without an end.
DROPPED_TAGS = ("table", "div", "script", "input", "style", "dl", "figure")
DROPPED_CLASSES = ("gallery", "mw-editsection", "reference", "reference-group", "references", "error", "nomobile", "noprint", "noexcerpt", "sortkey", "banner")
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def string_hash(text: Column) -> Column:
    """The 32-bit polynomial hash (31) of a text's UTF-16 units, as a signed long."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    add = lambda a, unit: F.pmod(a * 31 + unit, F.lit(4294967296))

    def step(a: Column, c: Column) -> Column:
        p = F.ascii(c).cast("long")
        high, low = F.lit(55296) + F.shiftright(p - 65536, 10), F.lit(56320) + (p - 65536).bitwiseAND(1023)
        return F.when(p > 65535, add(add(a, high), low)).otherwise(add(a, p))

    h = F.aggregate(chars, F.lit(0).cast("long"), step)
    return F.when(h >= 2147483648, h - 4294967296).otherwise(h)


def hash_bucket(text: Column, n: int = 10) -> Column:
    return F.pmod(F.abs(string_hash(text)), F.lit(n)).cast("int")


def clean_name(name: Column, page: Column) -> Column:
    """The name, or the page's where blank, up to the first `` (`` and the first ``<br>``."""
    base = F.when(F.coalesce(F.trim(name), F.lit("")) == "", page).otherwise(name)
    return F.regexp_replace(F.regexp_replace(base, r"(?s) \(.*$", ""), r"(?s)<br>.*$", "")


def wiki_link(page: Column, base: str = "https://example.org/wiki/") -> Column:
    return F.concat(F.lit(base), F.replace(page, F.lit(" "), F.lit("_")))


def page_and_name(key: Column) -> tuple[Column, Column]:
    """A result key cut at its first #."""
    at = F.instr(key, "#")
    return F.substring_index(key, "#", 1), F.when(at > 0, F.substr(key, at + 1))


def population_class(text: Column) -> Column:
    """0 (over 25 000) to 3: by number if the text is one, else by the first word class that occurs."""
    number = F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))
    low = F.lower(text)
    words = F.when(low.rlike("thorp|hamlet|village"), 3).when(low.rlike("town"), 2).when(low.rlike("city|cities"), 1).when(low.rlike("metropolis"), 0)
    by_number = F.when(number > 25000, 0).when(number > 5000, 1).when(number > 201, 2).otherwise(3)
    return F.when(number.isNotNull(), by_number).otherwise(F.coalesce(words, F.lit(3))).cast("int")


def article_length(n: Column) -> Column:
    return (F.ceil(n / 100) * 100).cast("int")


def popup_text(label: Column, link: Column, text: Column) -> Column:
    head = F.concat(F.lit("<h3>"), F.when(link.isNotNull(), F.concat(F.lit('<a href="'), link, F.lit('">'), label, F.lit("</a>"))).otherwise(label), F.lit("</h3>"))
    return F.concat(head, F.coalesce(text, F.lit("")))


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "(?s)<(script|style)[^>]*>.*?</\\1>", " "), "<[^>]*>", ""))


class _Excerpt(HTMLParser):
    """Keeps the flow text of an article: dropped parts go, links become absolute, titles and classes go."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=False)
        self.base, self.out, self.length, self.skip, self.open = base, [], 0, [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if self.skip or tag in DROPPED_TAGS or any(c in DROPPED_CLASSES for c in classes):
            if tag not in VOID_TAGS:
                self.skip.append(tag)
            return
        if tag == "a" and "new" in classes:
            self.open.append(None)
            return
        if tag not in VOID_TAGS:
            self.open.append(tag)
        href = a.get("href")
        if href and href.startswith("/"):
            href = self.base + href
        self.out.append(f'<{tag} href="{href}">' if href else f"<{tag}>")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip and self.skip.pop() != tag:
                    pass
            return
        if tag in VOID_TAGS or not self.open:
            return
        kept = self.open.pop()
        if kept:
            self.out.append(f"</{kept}>")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)
            self.length += len(data.strip())

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def article_excerpt(html: Column, base: str = "https://example.org") -> Column:
    """struct<length, excerpt>: length of the flow text, and the HTML up to the first heading; 0 and null for no text."""

    def udf(rows: pa.Array) -> pa.Array:
        import re

        from chronogeo.functions.text import _Excerpt

        lengths, texts = [], []
        for x in rows.to_pylist():
            p = _Excerpt(base)
            p.feed(x or "")
            p.close()
            lengths.append(p.length)
            texts.append(re.sub(r"(?s)<h\d.*", "", "".join(p.out)).strip() or None if p.length else None)
        return pa.StructArray.from_arrays([pa.array(lengths, pa.int32()), pa.array(texts, pa.string())], names=["length", "excerpt"])

    return F.arrow_udf(udf, "struct<length:int,excerpt:string>")(html)
