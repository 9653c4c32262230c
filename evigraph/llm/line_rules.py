"""Quality rules with cross-document line frequency: DataFrame functions only.

Base rules come from each text alone (words, symbols, repeated lines, repeated five-word windows). Then lines are
normalised (lower case, one space between words), hashed, and counted once a document and host; lines that more
documents of their host hold than its limit are taken out, and a document that keeps too few of its words is rejected.

Texts are read once: what is kept of a document is its counts and, for each line, a hash and a number of words. Hosts
only enter as a part of the key (host, line), so a hot host spreads over its lines; a line's documents are
counted before the shuffle. Frequent lines are few (each holds over the limit) and are broadcast only if counted so.

Defined results: null or empty text has no words and fails the base rules; a null source is a host of its own; rows with
equal ids stay rows of their own and count as documents of their own; no rows in, no rows out; other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, small

#: A line may stand in so many documents of its host, or in this share of them if that is more.
LINE_DOCS = 50
LINE_SHARE = 0.02
#: A document that keeps a smaller share of its words is depleted.
KEPT_SHARE = 0.5
MIN_WORDS = 10
MOST_REPEATED_PERCENT = 20
#: Words of a window whose repeats count.
SPAN = 5


def _let(value: str, name: str, body: str) -> str:
    """Evaluates an expression once and names it inside another."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words() -> str:
    """Words in windows found twice or more. Windows are sorted by hash and place only where a hash recurs."""
    n = SPAN
    window = ", ".join(["x", *(f"h[i + {k}]" for k in range(1, n))])
    steps = _let(
        "array_sort(transform(filter(s, (x, i) -> coalesce(x.k = get(s, i - 1).k, false) OR coalesce(x.k = get(s, i + 1).k, false)), x -> x.p))",
        "p",
        f"aggregate(transform(p, (x, i) -> least({n}, coalesce(get(p, i + 1) - x, {n}))), 0L, (a, b) -> a + b)",
    )
    repeated = _let("array_sort(transform(g, (x, i) -> named_struct('k', x, 'p', i)))", "s", steps)
    windows = _let(f"transform(slice(h, 1, size(h) - {n - 1}), (x, i) -> xxhash64({window}))", "g", f"CASE WHEN size(array_distinct(g)) = size(g) THEN 0L ELSE {repeated} END")
    return _let("transform(w, x -> xxhash64(x))", "h", f"CASE WHEN size(h) < {n} THEN 0L ELSE {windows} END")


def document_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts of each document, and of each line that has words its hash and number of words."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    word = WORD.replace("\\", "\\\\")
    counts = _let(
        f"regexp_extract_all(text, '{word}', 0)",
        "w",
        f"named_struct('n_words', cast(size(w) AS bigint), 'word_chars', aggregate(w, 0L, (a, x) -> a + length(x)), 'n_repeat_words', {_repeat_words()})",
    )
    lines = _let(
        f"filter(split(text, '\\n'), x -> x rlike '{word}')",
        "l",
        "named_struct('n_dup_lines', cast(size(l) - size(array_distinct(l)) AS bigint), 'lines', "
        f"transform(l, x -> named_struct('h', xxhash64(trim(regexp_replace(lower(x), '[\\\\x20\\\\x09-\\\\x0D]+', ' '))), 'w', regexp_count(x, '{word}'))))",
    )
    return (
        chosen.select("doc_id", "host", F.expr(counts).alias("c"), F.expr(lines).alias("l"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "host", "c.*", "n_symbols", "l.*")
    )


def frequent_lines(lines: DataFrame, most: int = LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """(host, h, docs) of lines above their host's limit."""
    counted = lines.select("host", F.explode(F.array_distinct("lines.h")).alias("h")).groupBy("host", "h").agg(F.count("*").alias("docs")).filter(F.col("docs") > most)
    hosts = lines.groupBy("host").agg(F.count("*").alias("host_docs"))
    return counted.alias("c").join(hosts.alias("n"), F.col("c.host").eqNullSafe(F.col("n.host"))).filter(F.col("docs") > share * F.col("host_docs")).select("c.host", "h", "docs")


def line_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", most: int = LINE_DOCS, share: float = LINE_SHARE, kept_share: float = KEPT_SHARE) -> DataFrame:
    """One row a document: base counts, words that frequent lines take out, and the verdict."""
    lines = cut(document_lines(docs, doc_id, text, host))
    frequent = small(cut(frequent_lines(lines, most, share))).alias("f")
    single = lines.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.w").alias("s")
    removed = single.join(frequent, F.col("s.host").eqNullSafe(F.col("f.host")) & (F.col("s.h") == F.col("f.h"))).groupBy("row").agg(F.sum("w").alias("removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce(F.col("removed"), F.lit(0))
    return (
        lines.drop("lines")
        .join(removed, "row", "left")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (left >= kept_share * F.col("n_words"))).alias("kept"), left.alias("words_left"))
    )


def without_frequent_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", most: int = LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """The documents with frequent lines taken out of their texts; all columns stay."""
    frequent = small(cut(frequent_lines(cut(document_lines(docs, doc_id, text, host)), most, share)))
    of, hashes = fresh(docs, "of_host"), fresh(docs, "frequent")
    by_host = frequent.groupBy(F.col("host").alias(of)).agg(F.collect_set("h").alias(hashes))
    joined = docs.join(by_host, F.col(host).eqNullSafe(F.col(of)), "left")
    hashed = "xxhash64(trim(regexp_replace(lower(x), '[\\\\x20\\\\x09-\\\\x0D]+', ' ')))"
    kept = F.expr(f"array_join(filter(split(`{text}`, '\\n'), x -> NOT array_contains(`{hashes}`, {hashed})), '\\n')")
    return joined.withColumn(text, F.when(F.col(hashes).isNull(), F.col(text)).otherwise(kept)).drop(of, hashes)
