"""Text functions on columns, and the same fold for the driver."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks (Latin-1 to Extended-B, Extended Additional) and the letters that they fold to.
_MARKED = "".join(chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if unicodedata.normalize("NFD", chr(c))[0] != chr(c))
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)
#: Combining marks, for text in decomposed form.
_COMBINING = "[\\u0300-\\u036f]"


def fold(c: Column | str) -> Column:
    """Lower case without marks; all but a-z, 0-9 and blanks becomes a blank; blanks collapse."""
    c = F.col(c) if isinstance(c, str) else c
    low = F.lower(F.translate(F.regexp_replace(c, _COMBINING, ""), _MARKED, _PLAIN))
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def fold_text(text: str) -> str:
    """X1 on the driver."""
    low = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()
    return " ".join(re.sub("[^a-z0-9 ]", " ", low).split())


def tokens(c: Column | str) -> Column:
    """The words of a text; an empty array for null and for texts without any."""
    return F.filter(F.split(F.coalesce(fold(c), F.lit("")), " "), lambda w: w != "")


def trigrams(c: Column | str) -> Column:
    """The distinct runs of three characters of the folded text, none if it is shorter."""
    f = fold(c)
    return F.when(
        F.length(f) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(f) - 2), lambda i: F.substring(f, i, F.lit(3))))
    ).otherwise(F.array().cast("array<string>"))


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 1 if either is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 1.0).otherwise(F.levenshtein(a, b) / longer)


def name_similarity(query: Column, name: Column) -> Column:
    """1 if either folded name contains the other, else the better of word by word and whole similarity."""
    q, n = fold(query), fold(name)
    words = F.filter(F.split(q, " "), lambda w: w != "")
    stored = F.filter(F.split(n, " "), lambda w: w != "")
    best = F.transform(words, lambda w: F.aggregate(stored, F.lit(0.0), lambda top, s: F.greatest(top, 1 - word_distance(w, s))))
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(words), F.lit(1))
    inside = F.contains(q, n) | F.contains(n, q)
    return F.when((q == "") | (n == ""), 0.0).when(inside, 1.0).otherwise(F.greatest(mean, 1 - word_distance(q, n)))


def name_overlap(query: Column, name: Column) -> Column:
    """The share of the stored words that the query holds."""
    asked, stored = tokens(query), tokens(name)
    hit = F.size(F.filter(stored, lambda w: F.array_contains(asked, w)))
    return F.when((F.size(stored) == 0) | (F.size(asked) == 0), 0.0).otherwise(hit / F.size(stored))


def term_coverage(text: Column, terms: list[str]) -> Column:
    """The share of terms (two characters or more when folded) that stand in the folded text; 1 without terms."""
    kept = [f for f in map(fold_text, terms) if len(f) >= 2]
    if not kept:
        return F.lit(1.0)
    f = fold(text)
    hit = sum((F.when(F.contains(f, F.lit(t)), 1).otherwise(0) for t in kept[1:]), F.when(F.contains(f, F.lit(kept[0])), 1).otherwise(0))
    return hit / F.lit(float(len(kept)))


def text_confidence(coverage: Column, position: Column, half_life: float = 10.0) -> Column:
    """Coverage decayed by the position (from 0) in the channel."""
    return coverage / (1 + position / F.lit(half_life))


def basename(path: Column) -> Column:
    """X35."""
    return F.element_at(F.split(path, "/"), -1)


def timecode(seconds: Column) -> Column:
    """Mm:ss, from an hour on h:mm:ss; 00:00 for null, negative and non-finite times."""
    ok = F.coalesce((seconds >= 0) & ~F.isnan(seconds) & (seconds < 1e9), F.lit(False))
    s = F.when(ok, F.round(seconds)).otherwise(0.0).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """X38."""
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def safe_path(path: Column) -> Column:
    """not empty, not absolute, without NUL and without a parent component."""
    return F.coalesce((path != "") & ~path.startswith("/") & ~F.contains(path, F.lit("\0")) & ~F.array_contains(F.split(path, "/"), ".."), F.lit(False))


def under_prefix(path: Column, prefix: str) -> Column:
    """in a folder (or everything for an empty prefix), never in a sibling whose name starts alike."""
    p = prefix.rstrip("/")
    return F.lit(True) if not p else (path == p) | path.startswith(p + "/")


def parse_date(text: Column) -> Column:
    """ISO 8601, else the form that cameras write."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")))

