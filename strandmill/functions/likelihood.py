"""Probabilities of whole reads, of one read at a time; the EM kernel has the same in bulk."""

from __future__ import annotations

import numpy as np

from strandmill.functions import matrix as M
from strandmill.functions.adm import Adm
from strandmill.functions.alphabet import IUPAC, reverse_complement

# Orientations of a pair of motifs, as bits of a set, and which of them are one in a homodimer.
ORIENTATION_BITS = {"HT": 1, "HH": 2, "TT": 4, "TH": 8}
HOMODIMER_PAIRS = (("HT", "TH"),)


def _site(s: str, model) -> float:
    with np.errstate(divide="ignore"):
        return model.log_probability(s) if isinstance(model, Adm) else float(np.log2(M.probability(s, np.asarray(model))))


def _log_background(s: str, q) -> float:
    return float(np.log2(np.asarray(q, float)[M.codes(s)]).sum()) if s else 0.0


def log_probability(read: str, model, pos: int, strand: int = 0, q=M.UNIFORM) -> float:
    """log2 probability of a read with a site at ``pos`` (from 0, forward), the rest background."""
    k = model.k if isinstance(model, Adm) else np.asarray(model).shape[1]
    site = read[pos : pos + k]
    rest = _log_background(read[:pos], q) + _log_background(read[pos + k :], q)
    return _site(reverse_complement(site) if strand else site, model) + rest


def log_pair_probability(read: str, left, right, d: int, pos: int, q=M.UNIFORM) -> float:
    """log2 probability of a read with two half-sites d >= 0 apart, the gap and the rest background."""
    k1, k2 = (m.k if isinstance(m, Adm) else np.asarray(m).shape[1] for m in (left, right))
    a, b = read[pos : pos + k1], read[pos + k1 + d : pos + k1 + d + k2]
    rest = read[:pos] + read[pos + k1 : pos + k1 + d] + read[pos + k1 + d + k2 :]
    return _site(a, left) + _site(b, right) + _log_background(rest, q)


def positional_log_probability(s: str, q: np.ndarray) -> float:
    """Under a background by position (4 x length)."""
    return float(np.log2(q[M.codes(s), np.arange(len(s))]).sum())


def class_probabilities(pattern: str, q=M.UNIFORM) -> list[float]:
    return [sum(q["ACGT".index(b)] for b in IUPAC[c]) for c in pattern]


def orientation_class(names) -> int:
    """A set of orientations as bits."""
    return sum(ORIENTATION_BITS[n] for n in set(names))


def orientations_of(bits: int, homodimer: bool = False) -> list[str]:
    """The orientations of a set; of a homodimer HT stands for TH as well."""
    names = [n for n, b in ORIENTATION_BITS.items() if bits & b]
    if homodimer:
        for keep, drop in HOMODIMER_PAIRS:
            if drop in names:
                names = [n for n in names if n != drop]
                names = names if keep in names else [keep, *names]
    return names
