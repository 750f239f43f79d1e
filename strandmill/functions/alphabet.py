"""Nucleotide and IUPAC alphabets, and patterns over them. Plain Python: patterns are short."""

from __future__ import annotations

import functools
import itertools
from math import comb

# The IUPAC classes as sets of bases, four bits A C G T from the highest.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T",
    "W": "AT", "S": "CG", "M": "AC", "K": "GT", "R": "AG", "Y": "CT",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
DNA, RNA = "ACGT", "ACGU"
_BIT = {"A": 8, "C": 4, "G": 2, "T": 1, "U": 1}
MASK = {c: sum(_BIT[b] for b in s) for c, s in IUPAC.items()}
FROM_MASK = {m: c for c, m in MASK.items() if c != "U"}
FROM = "ACGTWSMKRYBDHVN"
COMPLEMENT = "TGCAWSKMYRVHDBN"


def bases_of(c: str, rna: bool = False) -> str:
    """The bases of a class, in the alphabet of DNA or RNA."""
    s = IUPAC[c.upper()]
    return s.replace("T", "U") if rna else s


def complement_set(c: str, rna: bool = False) -> str:
    """The bases that a class does not have."""
    return "".join(b for b in (RNA if rna else DNA) if b not in bases_of(c, rna))


def matches(narrow: str, wide: str) -> bool:
    """Whether every base of one class is in the other."""
    return MASK[narrow] & ~MASK[wide] == 0


def string_matches(narrow: str, wide: str) -> bool:
    return len(narrow) == len(wide) and all(map(matches, narrow, wide))


def mismatch_positions(s: str, pattern: str) -> list[int]:
    return [i for i, (a, b) in enumerate(zip(s, pattern, strict=True)) if not matches(a, b)]


def reverse_complement(s: str, rna: bool = False) -> str:
    table = str.maketrans(FROM.replace("T", "U") if rna else FROM, COMPLEMENT.replace("T", "U") if rna else COMPLEMENT)
    return s.translate(table)[::-1]


def is_palindromic(s: str, rna: bool = False) -> bool:
    return s == reverse_complement(s, rna)


def palindromic_index(s: str) -> int:
    return sum(a != b for a, b in zip(s, reverse_complement(s), strict=True))


def combinations_of(pattern: str) -> int:
    n = 1
    for c in pattern:
        n *= len(IUPAC[c])
    return n


def sequences_of(pattern: str, rna: bool = False) -> list[str]:
    """All strings of a pattern, in lexicographic order."""
    return ["".join(x) for x in itertools.product(*(bases_of(c, rna) for c in pattern))]


def class_probability(c: str) -> dict[str, float]:
    """Uniform over the class."""
    s = IUPAC[c]
    return {b: (1 / len(s) if b in s else 0.0) for b in DNA}


def pattern_regex(pattern: str, rna: bool = False) -> str:
    return "".join(f"[{x}]" if len(x := bases_of(c, rna)) > 1 else x for c in pattern)


def hamming_ball_size(k: int, radius: int) -> int:
    return sum(comb(k, h) * 3**h for h in range(radius + 1))


@functools.lru_cache(256)
def neighbourhood(seed: str, radius: int, expand: bool = False, rna: bool = False) -> tuple[str, ...]:
    """Patterns at most ``radius`` mismatches from ``seed``; a class mismatches by the bases it lacks, N never does.

    With ``expand``, the strings of these patterns, each once and sorted.
    """
    open_ = [i for i, c in enumerate(seed) if complement_set(c)]
    out = []
    for r in range(min(radius, len(open_)) + 1):
        for places in itertools.combinations(open_, r):
            for letters in itertools.product(*(complement_set(seed[i], rna) for i in places)):
                s = list(seed)
                for i, c in zip(places, letters, strict=True):
                    s[i] = c
                out.append("".join(s))
    if expand:
        return tuple(sorted({s for p in out for s in sequences_of(p, rna)}))
    return tuple(out)


def contributions(s: str, seed: str, radius: int) -> list[int]:
    """The columns that a string counts for: all if it has fewer mismatches than ``radius``, with as many just these."""
    bad = mismatch_positions(s, seed)
    return list(range(len(seed))) if len(bad) < radius else bad if len(bad) == radius else []


def combine_overlap(a: str, b: str, d: int, how: str = "N") -> str:
    """Two seeds that overlap by -d columns as one: N in the overlap, or the union (or) or intersection (and) of classes."""
    o = -d
    if o <= 0:
        return a + "N" * d + b
    head, left, right, tail = a[: len(a) - o], a[len(a) - o :], b[:o], b[o:]
    if how == "N":
        mid = "N" * o
    else:
        mid = "".join(FROM_MASK.get(MASK[x] | MASK[y] if how == "or" else MASK[x] & MASK[y], "N") for x, y in zip(left, right, strict=True))
    return head + mid + tail


def jaccard_hamming(a: str, b: str) -> float:
    """Sum over positions of one less the Jaccard index of the classes."""
    return sum(1 - bin(MASK[x] & MASK[y]).count("1") / bin(MASK[x] | MASK[y]).count("1") for x, y in zip(a, b, strict=True))
