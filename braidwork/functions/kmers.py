"""Expressions on sequences and k-mers. All stay in the JVM and in generated code."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .windows import WORD, word_sizes

#: Symbol orders by which the lesser of a k-mer and its reverse complement may be chosen.
ORDERS = {"ACGT": None, "ACTG": "ACTG", "CATG": "CATG"}
#: P-mers that are no signature start with ACA, end in TGT or TT and any symbol, or hold AA after their first.
NOT_ALLOWED = "(TT.|TGT)$|^ACA|.AA"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(seq: str | Column) -> Column:
    """A sequence with its a, c, g and t in upper case. (Full upper-casing may turn one foreign letter into two and move all that follows.)"""
    return F.translate(_col(seq), "acgt", "ACGT")


def reverse_complement(seq: str | Column) -> Column:
    return F.reverse(F.translate(_col(seq), "ACGT", "TGCA"))


def lesser(forward: Column, backward: Column, order: str = "ACGT") -> Column:
    """The one that comes first where symbols are ordered as in ``order``."""
    if order == "ACGT":
        return F.least(forward, backward)
    if order not in ORDERS:
        raise ValueError(f"order is one of {', '.join(ORDERS)}")
    key = lambda c: F.translate(c, order, "0123")
    return F.when(key(forward) <= key(backward), forward).otherwise(backward)


def canonical(kmer: str | Column, order: str = "ACGT") -> Column:
    kmer = _col(kmer)
    return lesser(kmer, reverse_complement(kmer), order)


def is_kmer(kmer: str | Column) -> Column:
    """Only symbols, and at least one. (A pattern with ``$`` would let a final newline through.)"""
    return (F.length(_col(kmer)) > 0) & ~_col(kmer).rlike("[^ACGT]")


def packed(kmer: str | Column) -> Column:
    """The k-mer as a number to base 4, A to T as 0 to 3; for k to 31 in a long (longer ones: :func:`packed_words`)."""
    return F.conv(F.translate(_col(kmer), "ACGT", "0123"), 4, 10).cast("long")


def packed_words(kmer: str | Column, k: int) -> Column:
    """A k-mer of any length as longs of 31 symbols each, the last one of what is left."""
    return F.array(*[packed(F.substring(_col(kmer), at + 1, min(31, k - at))) for at in range(0, k, 31)])


def unpacked(words: str | Column, k: int) -> Column:
    """The k-mer that :func:`packed_words` has packed."""
    return F.concat(*[part for i, m in enumerate(word_sizes(k)) for part in _symbols_of(F.get(_col(words), F.lit(i)), m)])


def symbol(kmer: str | Column, at: int) -> Column:
    """The symbol at a place from 0."""
    return F.substring(_col(kmer), at + 1, 1)


def symbol_code(kmer: str | Column, at: int) -> Column:
    """A to T as 0 to 3."""
    return F.position(symbol(kmer, at), F.lit("ACGT")) - 1


def base_probability(quality: str | Column) -> Column:
    """The probability that a base is right, of its quality symbol; a quarter at the least."""
    return F.greatest(F.lit(0.25), 1 - F.pow(F.lit(10.0), -(F.ascii(_col(quality)) - 33) / 10.0))


def norm(p_mer: str | Column) -> Column:
    """A p-mer's number or its reverse complement's, the lesser of those allowed; 4^p if neither is."""
    p_mer = _col(p_mer)
    none = F.pow(F.lit(4.0), F.length(p_mer)).cast("long")
    of = lambda x: F.when(~x.rlike(NOT_ALLOWED), packed(x)).otherwise(none)
    return F.least(of(p_mer), of(reverse_complement(p_mer)))


def signature(kmer: str | Column, p: int) -> Column:
    """The least norm of a k-mer's p-mers."""
    kmer = _col(kmer)
    return F.array_min(F.transform(F.sequence(F.lit(1), F.length(kmer) - p + 1), lambda i: norm(F.substr(kmer, i, F.lit(p)))))


def register(spark: SparkSession) -> None:
    """SQL functions ``revcomp``, ``canonical_kmer`` and ``packed_kmer``, inlined wherever they are used."""
    rc = "reverse(translate(x, 'ACGT', 'TGCA'))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION revcomp(x STRING) RETURNS STRING RETURN {rc}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION canonical_kmer(x STRING) RETURNS STRING RETURN least(x, {rc})")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION packed_kmer(x STRING) RETURNS BIGINT RETURN CAST(conv(translate(x, 'ACGT', '0123'), 4, 10) AS BIGINT)")


def word_names(k: int) -> list[str]:
    """The columns of a packed k-mer: longs of 31 symbols each, the last one of what is left."""
    return [f"w{i}" for i in range(len(word_sizes(k)))]


def packed_columns(kmer: str | Column, k: int) -> list[Column]:
    """The words of a k-mer given as text, under their names."""
    return [packed(F.substring(_col(kmer), 1 + WORD * i, m)).alias(n) for i, (n, m) in enumerate(zip(word_names(k), word_sizes(k)))]


def _quads(n: int) -> Column:
    """All runs of n symbols, in order."""
    return F.lit(["".join(x) for x in product("ACGT", repeat=n)])


def _symbols_of(word: Column, m: int) -> list[Column]:
    """The m symbols of a word, four at a time from a table."""
    first = [F.get(_quads(m % 4), F.shiftright(word, 2 * (m - m % 4)).cast("int"))] if m % 4 else []
    return first + [F.get(_quads(4), F.shiftright(word, 2 * at).bitwiseAND(255).cast("int")) for at in range(m - m % 4 - 4, -1, -4)]


def spelled(k: int) -> Column:
    """The text of the packed k-mer in a row's columns, four symbols at a time from a table."""
    return F.concat(*[part for name, m in zip(word_names(k), word_sizes(k)) for part in _symbols_of(F.col(name), m)])
