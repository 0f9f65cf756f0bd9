"""Text expressions: line signatures, normalization, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s ]"
INK = r"[^\s ]"


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x made once, however often f names it, also inside f's lambdas."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def trim_all(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")


def signature(line: Column) -> Column:
    """What running lines have in common: trimmed, digit runs as #, lower case."""
    return F.lower(F.regexp_replace(trim_all(line), r"[0-9]+", "#"))


def unwrap(text: Column) -> Column:
    """Line ends, hyphens and paragraphs of a page: CRLF to LF, lines right-trimmed, words joined over
    line ends (a hyphen before a capital stays), single line ends to spaces, one blank line between
    paragraphs."""
    x = F.regexp_replace(text, r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t ]+\n", "\n")
    x = F.regexp_replace(x, r"(\p{L})-\n(\p{Ll})", "$1$2")
    x = F.regexp_replace(x, r"(\p{L})-\n(\p{Lu})", "$1-$2")
    x = F.regexp_replace(x, r"\n[ \t\r\f ]*\n[\s ]*", "\u0001")
    x = F.regexp_replace(x, r"\n", " ")
    x = F.regexp_replace(x, r"[ \t ]+", " ")
    x = F.regexp_replace(x, " *\u0001 *", "\n\n")
    return F.regexp_replace(x, r"^[ \n]+|[ \n]+$", "")


def normalize_name(x: Column) -> Column:
    """Lower case, possessives dropped, anything but letters, digits, & and spaces to a space, spaces
    collapsed, a leading article dropped. Spark has no compatibility normalization: a name node's
    texts go through functions.names.nfkc(), an Arrow function, before this."""
    x = F.regexp_replace(F.lower(x), r"['’]s(?![\p{L}\p{N}])", "")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}& ]+", " "), " +", " "))
    return F.regexp_replace(x, "^the ", "")


def name_tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def short_hash(x: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256: ids of documents, entities and relations."""
    return F.substring(F.sha2(x, 256), 1, 16)
