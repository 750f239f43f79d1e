"""Column functions on sequences. All are built-in expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmill.functions.alphabet import COMPLEMENT, FROM, IUPAC, MASK, matches, pattern_regex


def reverse_complement(s: Column, rna: bool = False) -> Column:
    a, b = (x.replace("T", "U") if rna else x for x in (FROM, COMPLEMENT))
    return F.reverse(F.translate(s, a, b))


def is_palindromic(s: Column, rna: bool = False) -> Column:
    return s == reverse_complement(s, rna)


def palindromic_index(s: Column) -> Column:
    return hamming_distance(s, reverse_complement(s))


def number_of(s: Column, base: int = 4) -> Column:
    """The code of a sequence of up to 31 bases; base 5 also knows N."""
    return F.conv(F.translate(F.translate(F.upper(s), "U", "T"), "ACGTN"[:base], "01234"[:base]), base, 10).cast("long")


def sequence_of(code: Column, k: Column | int, base: int = 4) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, base), k, F.lit("0")), "01234"[:base], "ACGTN"[:base])


def hamming_distance(a: Column, b: Column) -> Column:
    """Differing positions of two strings of one length; null if lengths differ."""
    n = F.length(a)
    diff = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda acc, i: acc + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))
    return F.when(n == F.length(b), F.when(n == 0, 0).otherwise(diff))


def hamming_of_codes(x: Column, y: Column) -> Column:
    """Hamming distance of two codes of two bits a base."""
    w = x.bitwiseXOR(y)
    return F.bit_count(w.bitwiseOR(F.shiftrightunsigned(w, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def min_hamming_distance(s: Column, t: Column) -> Column:
    """Smallest distance of t to a window of s."""
    n = F.length(s) - F.length(t)
    return F.when(n >= 0, F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(0)) + 1), lambda i: hamming_distance(F.substring(s, i, F.length(t)), t))))


def matches_pattern(s: Column, pattern: str, rna: bool = False) -> Column:
    return s.rlike(f"^{pattern_regex(pattern, rna)}$")


def contains_pattern(s: Column, pattern: str, rna: bool = False) -> Column:
    return s.rlike(pattern_regex(pattern, rna))


def _bad(s: Column, pattern: str, i: int) -> Column:
    good = "".join(c for c in IUPAC if matches(c, pattern[i]))
    return ~F.substring(s, i + 1, 1).isin(*good)


def pattern_distance(s: Column, pattern: str) -> Column:
    """Positions of s (as long as the pattern) that do not match."""
    total = F.lit(0)
    for i, c in enumerate(pattern):
        if c != "N":
            total = total + _bad(s, pattern, i).cast("int")
    return total


def mismatch_mask(s: Column, pattern: str) -> Column:
    """Bits of the mismatching positions, the first position highest."""
    k, total = len(pattern), F.lit(0).cast("long")
    for i, c in enumerate(pattern):
        if c != "N":
            total = total + F.when(_bad(s, pattern, i), F.lit(1 << (k - 1 - i)).cast("long")).otherwise(F.lit(0).cast("long"))
    return total


def mismatches(s: Column, pattern: str) -> Column:
    """Mismatching positions from 0."""
    return F.filter(F.array(*[F.when(_bad(s, pattern, i), i) for i in range(len(pattern))]), lambda x: x.isNotNull())


def is_nucleotide(s: Column, rna: bool = False) -> Column:
    return s.rlike("^[ACGU]+$" if rna else "^[ACGT]+$")


def is_iupac(s: Column) -> Column:
    return s.rlike(f"^[{''.join(IUPAC)}]+$")


def gap_count(s: Column, gap: str = "N") -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(gap), F.lit("")))


def defined_bases(s: Column, gap: str = "n") -> Column:
    return F.length(F.replace(s, F.lit(gap), F.lit("")))


def at_most_one_gap(s: Column, gap: str = "N") -> Column:
    """One run of gap characters at most, not at either end; null for a gap at an end."""
    return F.when(~s.rlike(f"^{gap}|{gap}$"), s.rlike(f"^[^{gap}]+({gap}+[^{gap}]+)?$"))


def unmasked_pieces(s: Column, k: int) -> Column:
    """Pieces between runs of N of at least k bases."""
    return F.filter(F.split(s, "N+"), lambda x: F.length(x) >= k)


def remove_gap(s: Column, pos: Column | int, gap: Column | int) -> Column:
    """s without ``gap`` bases after the first ``pos``."""
    pos, gap = (F.lit(x) if isinstance(x, int) else x for x in (pos, gap))
    return F.concat(F.substring(s, F.lit(1), pos), F.substring(s, pos + gap + 1, F.length(s)))


def split_fields(s: Column, sep: str) -> Column:
    """Fields of a string, empty ones left out."""
    return F.filter(F.split(s, f"\\Q{sep}\\E"), lambda x: x != "")


def base_counts(s: Column) -> Column:
    """Counts of A, C, G and T (or U)."""
    return F.array(*[F.length(s) - F.length(F.regexp_replace(s, b, "")) for b in ("A", "C", "G", "[TU]")])


def jaccard_hamming(a: Column, b: Column, k: int) -> Column:
    """Sum over k positions of one less the Jaccard index of the classes."""
    table = F.create_map(*[F.lit(x) for pair in MASK.items() for x in pair])
    total = F.lit(0.0)
    for i in range(1, k + 1):
        x, y = table[F.substring(a, i, 1)], table[F.substring(b, i, 1)]
        total = total + (1 - F.bit_count(x.bitwiseAND(y)) / F.bit_count(x.bitwiseOR(y)))
    return total


def trailing_ones(x: Column) -> Column:
    """Ones at the low end of a long."""
    y = F.bitwise_not(x)
    return F.bit_count(y.bitwiseAND(-y) - 1)


def leading_ones(x: Column, bits: int) -> Column:
    """Ones at the high end of a number of ``bits`` bits."""
    return F.length(F.regexp_extract(F.lpad(F.conv(x.cast("string"), 10, 2), bits, "0"), "^1*", 0))


def bits_in_range(x: Column, low: int, high: int) -> Column:
    """Ones among the bits low to high - 1."""
    return F.bit_count(F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << (high - low)) - 1)))
