"""Column expressions on texts. They read the whole text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker format of unfilled slots, and what separates tokens and sentences.
MARKER = r"\[FILL: ([^\]]*)\]"
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
TERM_CHARACTER = r"[\p{L}\p{N}]"
SENTENCE_SPLIT = r"[.!?\n]+"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def markers(text: Column | str) -> Column:
    """Names of the unfilled markers, in order, with repeats."""
    return F.regexp_extract_all(_c(text), F.lit(MARKER), F.lit(1))


def words(text: Column | str) -> Column:
    """Whitespace-separated words: what a length band counts."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def terms(text: Column | str) -> Column:
    """Lower-cased letter/digit runs."""
    return F.filter(F.split(F.lower(_c(text)), TOKEN_SPLIT), lambda w: w != "")


def sentences(text: Column | str) -> Column:
    parts = F.transform(F.split(_c(text), SENTENCE_SPLIT), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def shingle_hashes(text: Column | str, n: int) -> Column:
    """Hashes of the distinct n-term shingles; a shorter text is one shingle of all its terms."""

    def windows(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(t) - n, F.lit(0)))
        # Single elements instead of slice(), which copies the whole array each
        # time. Past the end get() is null, which the hash skips.
        hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(n)]))
        return F.when(F.size(t) > 0, F.array_distinct(hashed))

    # The outer transform binds the terms once; inlined into the inner lambda
    # the text would be split again for every shingle.
    return F.transform(F.array(terms(text)), windows)[0]
