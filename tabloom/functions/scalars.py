"""Scalar expressions: text clean-up, predicates, numeric helpers and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions import patterns


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Without white space at both ends."""
    return F.btrim(_c(col), F.lit(" \t\n\r\x0b\x0c"))


def normalize_text(col) -> Column:
    """Lower case, trimmed, without punctuation."""
    return F.regexp_replace(strip(F.lower(_c(col))), r"[^\p{L}\p{N}_\s]", "")


def digits_only(col) -> Column:
    return F.regexp_replace(_c(col), "[^0-9]", "")


def lower_email(col) -> Column:
    return F.lower(strip(col))


def title_case(col) -> Column:
    """Upper case for a letter that follows a non-letter, lower case otherwise (``o'neil`` -> ``O'Neil``)."""
    runs = F.regexp_extract_all(_c(col), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    rest = 1_000_000_000

    def cased(run):
        first = F.upper(F.substring(run, 1, 1))
        # some letters have two upper-case letters; only the first of them stays upper
        return F.concat(F.substring(first, 1, 1), F.lower(F.substring(first, 2, rest)), F.lower(F.substring(run, 2, rest)))

    return F.array_join(F.transform(runs, cased), "")


def concat_text(cols) -> Column:
    """Texts joined by a space, null as an empty text."""
    return F.concat_ws(" ", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols])


def contains_email(col) -> Column:
    return _c(col).rlike(patterns.EMAIL)


def contains_phone(col) -> Column:
    return _c(col).rlike(patterns.PHONE)


def contains_date(col) -> Column:
    return _c(col).rlike(patterns.DATE)


def contains_at(col) -> Column:
    return _c(col).contains("@")


def contains_digit(col) -> Column:
    return _c(col).rlike("[0-9]")


def truncate_text(col, n: int = 100) -> Column:
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def clamp(col, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(col)))


def safe_ratio(a, b) -> Column:
    """a / (b + 1e-8): the small constant keeps a zero divisor harmless."""
    return F.try_divide(_c(a), _c(b) + F.lit(1e-8))


def words(col) -> Column:
    """White-space separated words."""
    return F.filter(F.split(_c(col), r"\s+"), lambda w: w != "")


def ngrams(tokens: Column, n: int = 2) -> Column:
    """Neighbouring tokens joined by a space; empty when there are fewer than n."""
    k = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    made = F.slice(tokens, 1, k)
    for step in range(1, n):
        made = F.zip_with(made, F.slice(tokens, step + 1, k), lambda a, b: F.concat_ws(" ", a, b))
    return made


def slice_array(tokens: Column, n: int = 5) -> Column:
    return F.slice(tokens, 1, n)


def band(col, cuts, labels) -> Column:
    """labels[i] for the first cuts[i] (descending) that the value reaches, else the last label."""
    c, out = _c(col), None
    for cut, label in zip(cuts, labels):
        out = F.when(c >= cut, label) if out is None else out.when(c >= cut, label)
    return out.otherwise(labels[len(cuts)])
