"""Scalar functions: identifiers, terms, paths, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no terms of their own.
STOP_WORDS = ("and", "for", "from", "the", "with")
#: Boundaries in an identifier: lower or digit before upper, acronym before a word, anything that is no letter or digit.
_BOUNDARY = r"(?<=[\p{Ll}0-9])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|[^\p{L}\p{N}]+"


def tokens(name: Column) -> Column:
    """Lower-case words of an identifier or text: ``HTTPServer`` is http, server."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, _BOUNDARY, " ")), " +"), lambda x: x != "")


def reportable(term: Column) -> Column:
    """Terms of three bytes at least, not all digits, no stop word."""
    return (F.octet_length(term) >= 3) & ~term.rlike("^[0-9]+$") & ~term.isin(*STOP_WORDS)


def normal_term(term: Column) -> Column:
    """Lower case; letters, digits, plus and number sign stay, all else is one space."""
    return F.btrim(F.regexp_replace(F.lower(term), r"[^\p{L}\p{N}+#]+", " "))


def one_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def pair(left: Column, right: Column) -> tuple[Column, Column]:
    """Two terms in one order, whichever way they come."""
    return F.least(left, right), F.greatest(left, right)


def route(path: Column) -> Column:
    """A path template: ``:id`` and ``[id]`` become ``{id}``, whatever the name holds; empty segments go, all others stay."""
    segments = F.filter(F.split(F.trim(path), "/"), lambda x: x != "")
    inner = lambda x: F.when(x.startswith(":"), x.substr(F.lit(2), F.length(x))).when(x.startswith("[") & x.endswith("]"), x.substr(F.lit(2), F.greatest(F.length(x) - 2, F.lit(0))))
    named = F.transform(segments, lambda x: F.coalesce(F.concat(F.lit("{"), inner(x), F.lit("}")), x))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def route_key(method: Column, path: Column) -> Column:
    return F.concat_ws(" ", F.upper(method), route(path))


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob in which only ``**`` crosses separators."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in pattern[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def glob_matches(path: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | path.rlike(glob_regex(p))
    return found


def status_class(code: Column) -> Column:
    return (
        F.when(code.between(200, 399), "success").when(code.isin(401, 403), "auth").when(code.between(400, 499), "client_error").when(code.between(500, 599), "server_error").otherwise("other")
    )


def ngrams(words: Column, longest: int) -> Column:
    """Every run of up to ``longest`` neighbouring words, joined by a space."""

    def runs(w: Column) -> Column:
        places = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(places, lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(w) - s + 1)), lambda n: F.array_join(F.slice(w, s, n), " "))))

    return F.get(F.transform(F.array(words), runs), F.lit(0))  # the words are computed once


def canonical_map(column: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))


def instant(text: Column) -> Column:
    """An RFC 3339 instant in UTC seconds, or null."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def percent_encoded(text: Column) -> Column:
    """UTF-8 bytes but letters, digits and ``-_.~`` as percent and two digits (a space is %20)."""
    form = F.url_encode(text)
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_decoded(text: Column) -> Column:
    """The text behind percent signs; a plus stays one."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
