"""Scalar functions as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Openings of lines that lead away from an article, and how connection errors and access errors read.
HATNOTES = ("Main article", "Main topic", "For other uses", "Part of a series on", "This article is about", "Not to be confused", "This list is incomplete", "See also", "In other")
RETRYABLE = "(?i)connect|timeout|refused|unreachable|connection"
ACCESS = r"(^|[^\p{L}\p{N}])(401|403)([^\p{L}\p{N}]|$)"
#: The greatest 4-byte float.
GREATEST_FLOAT = 3.4028234663852886e38
FATAL_STATES = ("error", "missingFiles")
COMPLETE_STATES = ("uploading", "stalledUP", "pausedUP", "forcedUP")
ACTIVE_STATES = ("downloading", "forcedDL", "stalledDL", "metaDL", "forcedMetaDL", "checking", "allocating", "moving")


def code(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_newlines(c) -> Column:
    return F.regexp_replace(code(c), "\n{3,}", "\n\n")


def derive_title(path) -> Column:
    return F.translate(F.element_at(F.split(code(path), "/"), -1), "_", " ")


def truncate(c, n: int) -> Column:
    c = code(c)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def was_truncated(c, n: int) -> Column:
    return F.length(code(c)) > n


def byte_head(c, limit: int) -> Column:
    """The longest start of whole characters in at most `limit` UTF-8 bytes."""
    raw = F.left(code(c), F.lit(limit + 1)).cast("binary")
    # bytes 80 to BF continue a character: if one follows the limit, the character that it belongs to goes
    follows = lambda at: F.hex(F.substring(raw, at, 1)).between("80", "BF")
    end = F.when(~follows(limit + 1), limit).when(~follows(limit), limit - 1).when(~follows(limit - 1), limit - 2).otherwise(limit - 3)
    return raw.substr(F.lit(1), end).cast("string")


def sentence_cut(c, limit: int) -> Column:
    """Text of at most `limit` UTF-8 bytes as it is; else whole characters of so many bytes, cut after the last full stop, with an ellipsis."""
    c = code(c)
    head = byte_head(c, limit)
    upto = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.when(upto != "", upto).otherwise(head)), F.lit("…")))


def snippet(c) -> Column:
    """The first line of 50 bytes and more that is no hatnote, cut at a sentence; else the first 200 characters."""
    lines = F.filter(F.split(code(c), "\n"), lambda x: (F.octet_length(F.trim(x)) >= 50) & ~F.trim(x).rlike("^(" + "|".join(HATNOTES) + ")"))
    line = F.trim(F.get(lines, F.lit(0)))
    return F.coalesce(sentence_cut(line, 300), F.left(code(c), F.lit(200)))


def preview(c) -> Column:
    return F.left(code(c), F.lit(2000))


def entity_id(html) -> Column:
    """The first entity link with #identifiers in the first 512 KiB, else the first of any; ids beyond a long are passed over."""
    head = F.left(code(html), F.lit(512 * 1024))

    def first(pattern: str) -> Column:
        return F.get(F.filter(F.transform(F.regexp_extract_all(head, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull()), F.lit(0))

    return F.coalesce(first(r"wikidata\.org/wiki/Q(\d+)#identifiers"), first(r"wikidata\.org/wiki/Q(\d+)"))


def parse_date(c) -> Column:
    s = F.trim(code(c))
    forms = ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"), (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z?$", None))
    return F.coalesce(*[F.when(s.rlike(p), F.try_to_date(s, f) if f else F.try_to_date(F.left(s, F.lit(10)), "yyyy-MM-dd")) for p, f in forms])


def base_name(name) -> Column:
    tail = r"_(\d{4}-\d{2}(-\d{2})?|\d{6})$"
    return F.regexp_replace(code(name), tail, "")


def version(name) -> Column:
    """struct<year, month> of a dated name, else null; the day is dropped."""
    t = F.regexp_extract(code(name), r"_(\d{4}-\d{2}(?:-\d{2})?|\d{6})$", 1)
    digits = F.regexp_replace(t, "-", "")
    return F.when(t != "", F.struct(F.left(digits, F.lit(4)).cast("int").alias("year"), F.substring(digits, 5, 2).cast("int").alias("month")))


def without_query(url) -> Column:
    return F.regexp_replace(code(url), "[?#].*$", "")


def default_name(url) -> Column:
    return F.element_at(F.split(without_query(url), "/"), -1)


def is_direct(url, suffix: str = ".zim") -> Column:
    return F.lower(F.trim(without_query(url))).endswith(suffix)


def catalog_name(url, suffix: str = ".zim") -> Column:
    last = F.lower(default_name(url))
    stem = F.left(last, F.length(last) - len(suffix))
    return F.when(last.endswith(suffix) & (stem != ""), stem)


def normal_digest(hexed, base64) -> Column:
    h = F.when(F.lower(F.trim(code(hexed))).rlike("^[0-9a-f]{64}$"), F.lower(F.trim(code(hexed))))
    raw = F.try_to_binary(F.trim(code(base64)), F.lit("base64"))
    b = F.when(F.octet_length(raw) == 32, F.lower(F.hex(raw)))
    return F.when(h.isNotNull() & b.isNotNull() & (h != b), None).otherwise(F.coalesce(h, b))


def digest_valid(c) -> Column:
    return code(c).isNull() | code(c).rlike("^[0-9a-f]{64}$")


def embed_text(snip, body) -> Column:
    return F.concat(F.coalesce(code(snip), F.lit("")), F.lit(" "), F.coalesce(F.left(code(body), F.lit(500)), F.lit("")))


def eta_seconds(remaining, rate) -> Column:
    return F.when(code(rate) > 0, F.call_function("div", code(remaining), code(rate)))


def kib_to_bytes(rate) -> Column:
    return F.coalesce(F.try_multiply(code(rate).cast("bigint"), F.lit(1024).cast("bigint")), F.lit(2**63 - 1))


def display_title(name) -> Column:
    return F.translate(code(name), "_", " ")


def redact_url(url) -> Column:
    return F.regexp_replace(code(url), "^([^/]*?://)[^/?#]*@", "$1***@")


def valid_name(c) -> Column:
    c = code(c)
    return (F.trim(c) == c) & (c != "") & (F.octet_length(c) <= 255) & ~c.rlike(r"[/\\\x00]") & ~c.contains("..") & ~c.startswith(".")


def retryable_error(c) -> Column:
    return F.coalesce(code(c).rlike(RETRYABLE), F.lit(False))


def access_error(c) -> Column:
    return F.coalesce(code(c).rlike(ACCESS), F.lit(False))


def like_escape(c) -> Column:
    """A text in which no character means anything to LIKE with a backslash as escape."""
    return F.regexp_replace(code(c), r"([\\%_])", r"\\$1")


def contains_text(c, part) -> Column:
    """Whether a text contains another, taken literally, as a LIKE pattern."""
    return F.like(code(c), F.concat(F.lit("%"), like_escape(part), F.lit("%")), F.lit("\\"))


def starts_with_text(c, part) -> Column:
    return F.like(code(c), F.concat(like_escape(part), F.lit("%")), F.lit("\\"))


def is_wiki_archive(name, language, description=None, publisher=None) -> Column:
    """Whether an archive is a wiki: its language begins with a letter, and its name, description or publisher says so. Unknown ones say nothing."""
    says = lambda c, *words: F.coalesce(reduce(Column.__or__, [F.lower(code(c)).contains(w) for w in words]), F.lit(False))
    said = says(name, "wikipedia", "wiki_")
    for c in (description, publisher):
        said = said | says(c, "wikipedia") if c is not None else said
    return F.coalesce(code(language).rlike("^[A-Za-z]"), F.lit(False)) & said


def is_complete(progress, state) -> Column:
    return (code(progress) >= 0.999) & code(state).isin(*COMPLETE_STATES)


def is_active(state) -> Column:
    return code(state).isin(*ACTIVE_STATES)


def is_fatal(state) -> Column:
    return code(state).isin(*FATAL_STATES)


def sha256_hex(c) -> Column:
    """SHA-256 of the UTF-8 bytes in lower-case hex."""
    return F.sha2(code(c).cast("binary"), 256)


def clean_fraction(c) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(code(c), F.lit(0.0)), F.lit(0.0))))


def clean_ratio(c) -> Column:
    """A ratio of 0 and more that a 4-byte float can hold; none for what is no number."""
    return F.greatest(F.lit(0.0), F.least(F.lit(GREATEST_FLOAT), F.nanvl(F.coalesce(code(c), F.lit(0.0)), F.lit(0.0))))


def clean_count(c) -> Column:
    return F.greatest(F.coalesce(code(c), F.lit(0)), F.lit(0))


def trigrams(c) -> Column:
    """Distinct 3-grams of each alphanumeric word, lower-cased and padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(code(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def similarity(grams_a: Column, grams_b: Column) -> Column:
    union = F.size(F.array_union(grams_a, grams_b))
    return F.when(union > 0, F.size(F.array_intersect(grams_a, grams_b)) / union).otherwise(F.lit(0.0))


def tokens(c) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(code(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
