"""Text functions as Spark columns. A null text counts as empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named characters of HTML and what they stand for; the ampersand
# comes last, so that nothing is decoded twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&amp;": "&"}

#: What is not visible: the head, scripts, styles and comments. One that is not
#: closed reaches the end.
HIDDEN = r"(?is)<head(?:\s[^>]*)?>.*?</head\s*>|<script[^>]*>.*?(?:</script\s*>|\z)|<style[^>]*>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
TITLE = r"(?i)<title[^>]*>([^<]*)</title"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def term_counts(words: Column) -> Column:
    """Array of (term, tf) of an array of sorted words, whose equals are
    neighbours, so a text is counted where it is read. words is used several
    times: give it a column, not an expression."""
    n = F.size(words)
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
    ends = F.concat(F.slice(first, 2, n), F.array(n))
    return F.when(n > 0, F.zip_with(first, ends, lambda a, b: F.struct(F.get(words, a).alias("term"), (b - a).cast("bigint").alias("tf")))).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def chunk_array(words: Column, size: int = 64, stride: int = 48) -> Column:
    """Array of (chunk_ix, chunk): windows of `size` tokens, `stride` apart;
    the last one reaches the end. A text without tokens has none."""
    n = F.size(words)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(stride))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.cast("bigint").alias("chunk_ix"), F.array_join(F.slice(words, i * stride + 1, size), " ").alias("chunk")))
    return F.when(n > 0, parts)


def _decoded(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)


def html_title(html: Column) -> Column:
    return _decoded(F.regexp_extract(F.coalesce(html, F.lit("")), TITLE, 1))


def html_body(html: Column) -> Column:
    """Visible text: without scripts, styles, comments, the head and tags;
    entities decoded, white space collapsed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    return F.trim(F.regexp_replace(_decoded(F.regexp_replace(bare, r"<[^>]*>", " ")), r"[ \t\n\r]+", " "))
