"""Cleaning of encyclopaedia articles: normal form, ordered substitutions, quotes, and a check of what is left."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.normal_forms import nfkc
from textmill.functions.text import col, let

#: Any case, lines, dots that match line ends, Unicode classes, and only line feeds as line ends.
FLAGS = "(?imsUd)"
#: Patterns of the article cleaner with their replacements, in the order in which they are applied.
ARTICLE = (
    (r"[​‌‍﻿]+", " "),
    (r"\d+°\d+[′']+(?:\d+(?:\.\d+)?[″\"′]+)?[NSEW]\s+\d+°\d+[′']+(?:\d+(?:\.\d+)?[″\"′]+)?[NSEW]\s*/\s*\d+\.\d+°?[NSEW]\s+\d+\.\d+°?[NSEW]\s*/\s*-?\d+\.\d+;\s*-?\d+\.\d+", ""),
    (r"^\s*\d+°\d+[′']+(?:\d+(?:\.\d+)?[″\"′]+)?[NSEW]\s+\d+°\d+[′']+(?:\d+(?:\.\d+)?[″\"′]+)?[NSEW]\s*/", ""),
    (r"\d+°\d+[′']+(?:\d+(?:\.\d+)?[″\"′]+)?[NSEW]\s+\d+°\d+[′']+(?:\d+(?:\.\d+)?[″\"′]+)?[NSEW]\s*/", ""),
    (r"\d+°\d+[′']+\d+(?:\.\d+)?[″\"′]+[NSEW]\s+\d+°\d+[′']+\d+(?:\.\d+)?[″\"′]+[NSEW]", ""),
    (r"\d+°\d+[′']+[NSEW]\s+\d+°\d+[′']+[NSEW]", ""),
    (r"\d+\.\d+°[NSEW]\s+\d+\.\d+°[NSEW]", ""),
    (r"-?\d+\.\d+;\s*-?\d+\.\d+", ""),
    (r"/\s*\d+\.\d+°?[NSEW]?\s+\d+\.\d+°?[NSEW]?", ""),
    (r"/\s*-?\d+\.\d+;\s*-?\d+\.\d+", ""),
    (r"\d+°\d+[′']+\d+(?:\.\d+)?[″\"′]+[NSEW]", ""),
    (r"\d+°\d+[′']+[NSEW]", ""),
    (r"\d+\.\d+°[NSEW]", ""),
    (r"^\s*/\s*", ""),
    (r"\n\s*/\s*", "\n"),
    (r"^.*?\d+°\d+[′']+.*?[NSEW].*?$", ""),
    (r"\([^)]*(?:Arabic|French|German|Spanish|Italian|Portuguese|Dutch|Chinese|Japanese|Korean|Hindi|Russian):[^)]*\)", ""),
    (r"\([^)]*[؀-ۿݐ-ݿ一-鿿぀-ゟ゠-ヿЀ-ӿ][^)]*\)", ""),
    (r"/[ˈˌəɪiːɛæɑɒɔʊuːʌɜːɪəeɪaɪɔɪaʊɪəeəʊəbdfghjklmnpqrstvwxzʃʒθðŋʧʤ]+/", ""),
    (r"^[\"'‘’“”„‚«»]+\s*", ""),
    (r"\s*[\"'„‚«»]+$", ""),
    (r"\n{3,}", "\n\n"),
    (r"^\n+|\n+$", ""),
    (r"\\n", "\n"),
    (r"\{\{[^}]*\}\}", ""),
    (r"\[\[([^|\]]*\|)?([^\]]*)\]\]", "$2"),
    (r"\[http[^\s\]]*\s*([^\]]*)\]", "$1"),
    (r"<ref[^>]*>.*?</ref>", ""),
    (r"<ref[^>]*/?>", ""),
    (r"<[^>]+>", ""),
    (r"&nbsp;", " "),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&apos;", "'"),
    (r"&#\d+;", ""),
    (r"\[\d+\]", ""),
    (r"\(citation\s+needed\)", ""),
    (r"\(verify\)", ""),
    (r"\(disambiguation\)", ""),
    (r"â€™", "'"),
    (r"â€œ", '"'),
    (r"â€", '"'),
    (r"â€\"", "–"),
    (r"â€\"", "—"),
    (r"Â", ""),
    (r"â€¦", "..."),
    (r"[ \t]+", " "),
    (r" +", " "),
    (r"^\s+|\s+$", ""),
)


def has(*signs: str) -> Callable[[Column], Column]:
    """Whether all the signs, which have no case, occur in a text."""
    return lambda x: reduce(and_, (F.contains(x, F.lit(s)) for s in signs))


def some(*signs: str) -> Callable[[Column], Column]:
    return lambda x: reduce(or_, (F.contains(x, F.lit(s)) for s in signs))


#: Groups of patterns of ARTICLE, as many each, with a cheap test that each text passes in which one of them changes anything.
GROUPS = (
    (1, some("\u200b", "\u200c", "\u200d", "\ufeff")), (3, has("°")), (3, has("°")), (3, lambda x: has(".")(x) & some(";", "/")(x)), (3, has("°")), (2, has("/")), (1, has("°")), (2, has("(", ")")), (1, has("/")),
    (1, some(*"\"'‘’“”„‚«»")), (1, lambda x: x.rlike(FLAGS + "[\"'„‚«»]$")), (2, has("\n")), (1, has("\\")), (6, some("{{", "[", "<")), (2, has("&", ";")), (5, has("&", ";")), (4, some("[", "(")), (7, some("€", "Â", "â")),
    (2, some("\t", "  ")), (1, lambda x: x.rlike(FLAGS + r"^\s|\s$")),
)
#: Quotation marks and what stands for them.
QUOTES = (("«", '"'), ("»", '"'), ("„", '"'), ("‚", "'"), ("‹", "'"), ("›", "'"))


def unescaped(text: Column) -> Column:
    r"""Texts with ``\x`` read as escaped Latin-1 bytes of UTF-8; a text that is not stays as it is."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        def read(t: str | None) -> str | None:
            if t is None or "\\x" not in t:
                return t
            try:
                return t.encode().decode("unicode_escape").encode("latin1").decode("utf-8")
            except UnicodeError:
                return t

        return pa.array([read(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def grouped() -> Iterator[tuple[tuple[tuple[str, str], ...], Callable[[Column], Column]]]:
    """The patterns of each group, in order, and its test."""
    at = 0
    for n, needed in GROUPS:
        yield ARTICLE[at : at + n], needed
        at += n


def replaced(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, F.lit(FLAGS + p[0]), F.lit(p[1])), patterns, text)


def substituted(text: Column) -> Column:
    """The text after all patterns of ARTICLE; a group is applied only where it may change something."""
    return reduce(lambda x, group: let(x, lambda y: F.when(group[1](y), replaced(y, group[0])).otherwise(y)), grouped(), text)


def clean_article(text: Column | str) -> Column:
    """The cleaned text of an article on one line; "" for null, and for what is left with ten characters or fewer, of figures only or of signs only."""
    x = substituted(unescaped(nfkc(F.coalesce(col(text), F.lit("")))))
    x = F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    for sign, plain in QUOTES:
        x = F.replace(x, F.lit(sign), F.lit(plain))
    bad = lambda y: (F.length(y) <= 10) | y.rlike(r"(?U)^\d+\.?\s*$") | y.rlike(r"(?U)^[^\w]*$")
    return let(x, lambda y: F.when(bad(y), "").otherwise(y))
