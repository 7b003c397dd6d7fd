"""Column functions over headers and sequences: all built in, nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ALPHABET, AMBIGUOUS_TERMS

# Base pairs of RNA.
PAIRS = ("ACGU", "UGCA")


def is_ambiguous_label(header: Column, terms: Sequence[str] = AMBIGUOUS_TERMS, word_boundary: bool = False) -> Column:
    """Whether a header holds one of the terms in any case; with word_boundary not as a part of a longer word."""
    low = F.lower(header)
    out = F.lit(False)
    for t in terms:
        pattern = r"(^|[^a-z0-9])" + "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in t.lower()) + r"($|[^a-z0-9])"
        out = out | (F.regexp_like(low, F.lit(pattern)) if word_boundary else F.contains(low, F.lit(t.lower())))
    return out


def ambiguous_bases(sequence: Column, alphabet: str = ALPHABET) -> Column:
    """Letters outside the alphabet."""
    return F.length(F.translate(F.upper(sequence), alphabet, ""))


def quality_reason(sequence: Column, min_len: int, max_len: int, max_n_frac: float, alphabet: str = ALPHABET) -> Column:
    """``pass``, or the first reason against a sequence: its length, emptiness, its share of other letters."""
    n = F.length(sequence)
    return F.when((n < min_len) | (n > max_len), "length_out_of_range").when(n == 0, "empty_sequence").when(ambiguous_bases(sequence, alphabet) > F.lit(float(max_n_frac)) * n, "too_many_ambiguous_bases").otherwise("pass")


def accession(header: Column, index: Column) -> Column:
    """The header's first token, or ``seq`` and the record's index if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(header, r"(\S+)", 1), F.lit("")), F.concat(F.lit("seq"), index.cast("string")))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, *PAIRS))


def windows(sequence: Column, k: int, letters: str = ".") -> Column:
    """All overlapping windows of k letters, in order; a lookahead takes time in proportion to the length."""
    return F.regexp_extract_all(sequence, F.lit(f"(?=({letters}{{{k}}}))"), F.lit(1))


def kmers(sequence: Column, k: int, alphabet: str = ALPHABET) -> Column:
    """Windows that hold letters of the alphabet only."""
    return windows(F.upper(sequence), k, f"[{alphabet}]")


def kmer_index(kmer: Column, alphabet: str = ALPHABET) -> Column:
    """A k-mer's place in the sorted vocabulary: its letters are digits."""
    digits = "".join("0123456789abcdefghijklmnopqrstuvwxyz"[i] for i in range(len(alphabet)))
    return F.conv(F.translate(kmer, alphabet, digits), len(alphabet), 10).cast("long")


def normalized(features: Column) -> Column:
    """Each value over the row's sum; null where the sum is 0."""
    total = F.aggregate(features, F.lit(0.0), lambda a, x: a + x)
    return F.transform(features, lambda x: F.try_divide(x, total))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (label == c).cast("int"))


def has_missing(features: Column) -> Column:
    return F.exists(features, lambda x: x.isNull() | F.isnan(x))


def safe_name(name: Column) -> Column:
    """Usable in a file name."""
    return F.translate(name, " /", "__")
