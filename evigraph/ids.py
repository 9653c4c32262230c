"""Ids of nodes and findings, and cursors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escaped(part: Column) -> Column:
    """A segment of an id: ``~`` and ``/`` are written ``~0`` and ``~1``."""
    return F.replace(F.replace(part, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def file_id(project: Column, path: Column) -> Column:
    return F.concat_ws("/", F.lit("file"), escaped(project), escaped(path))


def symbol_id(file: Column, local: Column) -> Column:
    return F.concat_ws("/", F.lit("symbol"), escaped(file), escaped(local))


def digest(*parts: Column, domain: str = "") -> Column:
    """SHA-256 of the domain and the parts, each with its length in bytes before it, so that no two lists meet."""
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat(F.lit(domain), *[x for t in text for x in (F.lit("|"), F.octet_length(t).cast("string"), F.lit(":"), t)]), 256)


def cursor(*parts: Column) -> Column:
    """Base64 for URLs, without padding."""
    return F.rtrim(F.translate(F.base64(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), "+/\r\n", "-_"), F.lit("="))


def read_cursor(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.split(F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))).cast("string"), "\\|")
