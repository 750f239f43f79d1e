"""Mixture model of background, monomer motifs and motif pairs, fitted by expectation maximisation.

One Spark job a round. Its kernel takes an Arrow batch of reads, forms the posterior of every site in numpy and
returns sums only; posteriors never leave the batch. The models, a few thousand numbers, stay on the driver.

With an order-zero background all bases outside a site cancel. A component c at a site has the odds
u = lambda_c / (sites * strands) * prod p(base) / q(base), and the posterior u / (lambda_bg + sum u).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import adm as A
from strandmill.functions import matrix as M
from strandmill.functions.alphabet import bases_of, combine_overlap, neighbourhood, reverse_complement
from strandmill.operators import counts as C
from strandmill.operators.windows import commonest_completions, pattern_counts, seed_hits
from strandmill.storage import spread

ORIENTATIONS = ("HT", "HH", "TT", "TH")


@dataclass(frozen=True)
class Config:
    """Parameters; radius None is 2 for ppm and 3 for the order-one models."""

    model: str = "ppm"  # ppm, adm-unfixed, adm-fixed (alias adm)
    two_strands: bool = True
    rna: bool = False
    radius: int | None = None
    gate: bool = True  # count only sites near the seed
    prior: str = "none"  # none, addone, dirichlet
    adjust_seeds: bool = True
    fixed_monomers: tuple[int, ...] = ()
    purely_modular: float = 1.0  # weight of a motif's dimers at least min_distance apart from which its own sites no longer count
    max_iter: int = 150
    epsilon: float = 0.01
    dmin: int | None = None
    dmax: int = 10
    max_gap: int = 0
    min_distance: int = 4
    ic_threshold: float = 0.40
    cob_cutoff: float = 0.001
    combine: str = "N"
    background_fraction: float = 0.5
    cob: tuple[tuple[int, int], ...] | str = ()
    oscillation_from: int = 50
    oscillation_rounds: int = 15
    freqs: tuple[float, ...] | None = None  # first background, in place of that of the reads
    directional_seeds: bool = False  # seeds of overlapping cases are no near palindromes

    def __post_init__(self):
        if self.model == "adm":
            object.__setattr__(self, "model", "adm-fixed")
        if self.model not in ("ppm", "adm-unfixed", "adm-fixed"):
            raise ValueError(f"unknown model {self.model}")
        if self.prior not in ("none", "addone", "dirichlet") or self.combine not in ("N", "or", "and"):
            raise ValueError("unknown prior or way to combine seeds")
        if self.radius is None:
            object.__setattr__(self, "radius", 2 if self.model == "ppm" else 3)
        if self.rna and self.two_strands:
            object.__setattr__(self, "two_strands", False)
        if self.freqs is not None and (len(self.freqs) != 4 or min(self.freqs) <= 0 or abs(sum(self.freqs) - 1) > 1e-6):
            raise ValueError("four positive frequencies that sum to 1 are needed")
        if not 0 < self.background_fraction < 1 or self.epsilon <= 0 or self.max_iter < 0 or self.radius < 0:
            raise ValueError("parameter out of range")


@dataclass
class Pair:
    """A table of dimer cases (orientation, distance) of two motifs, with what was learned of each."""

    tf1: int
    tf2: int
    orientations: tuple[str, ...]
    dmin: int
    dmax: int
    lambdas: dict[tuple[str, int], float]
    seeds: dict[tuple[str, int], str] = field(default_factory=dict)
    observed: dict[tuple[str, int], np.ndarray] = field(default_factory=dict)
    deviation: dict[tuple[str, int], np.ndarray] = field(default_factory=dict)


@dataclass
class State:
    """Everything a round needs; models are transition tensors (4 x 4 x k), an order-zero one repeats its columns."""

    models: list[np.ndarray]
    seeds: list[str]
    lambdas: list[float]
    background: np.ndarray
    pairs: list[Pair] = field(default_factory=list)

    @property
    def lambda_bg(self) -> float:
        return 1 - sum(self.lambdas) - sum(sum(p.lambdas.values()) for p in self.pairs)


@dataclass
class Result:
    state: State
    history: list[dict]
    converged: bool


def tensor(m: np.ndarray) -> np.ndarray:
    return np.repeat(m[None], 4, 0) if m.ndim == 2 else m


def ppm(t: np.ndarray) -> np.ndarray:
    """Marginals of a transition tensor."""
    return A.Adm(t).ip


def oriented(a, b, o: str, rna: bool, turn):
    """The two halves of a dimer as they stand on the forward strand."""
    if rna:
        return (a, b) if o == "HT" else (b, a)
    return (turn(a) if o[0] == "T" else a), (turn(b) if o[1] == "H" else b)


def _turn(t: np.ndarray) -> np.ndarray:
    return A.Adm(t).reverse_complement().t


@dataclass
class Component:
    """Parts (offset, tensor) of a site of one width, with its weight."""

    key: tuple
    parts: list[tuple[int, np.ndarray]]
    width: int
    weight: float


def expected(state: State, pair: Pair, o: str, d: int, cfg: Config) -> np.ndarray:
    """Transition tensor of two independent halves d apart."""
    a, b = oriented(state.models[pair.tf1], state.models[pair.tf2], o, cfg.rna, _turn)
    if cfg.model == "ppm":
        return tensor(M.product(ppm(a), ppm(b), d))
    return A.product(A.Adm(a), A.Adm(b), d).t


def components(state: State, cfg: Config) -> list[Component]:
    out = [Component(("m", k), [(0, t)], t.shape[2], state.lambdas[k]) for k, t in enumerate(state.models)]
    for r, pair in enumerate(state.pairs):
        for (o, d), weight in pair.lambdas.items():
            if weight <= 0:
                continue
            a, b = oriented(state.models[pair.tf1], state.models[pair.tf2], o, cfg.rna, _turn)
            width = a.shape[2] + b.shape[2] + d
            if d <= cfg.max_gap:
                t = expected(state, pair, o, d, cfg) + pair.deviation.get((o, d), 0.0)
                parts = [(0, np.maximum(t, 0.0))]
            else:
                parts = [(0, a), (a.shape[2] + d, b)]
            out.append(Component(("d", r, o, d), parts, width, weight))
    return out


def encode(seqs: list[str]) -> np.ndarray:
    """Codes 0 to 3 of reads of one length; a read with an ambiguous base raises."""
    table = np.full(256, 255, np.uint8)
    for i, c in enumerate("ACGT"):
        table[[ord(c), ord(c.lower())]] = i
    table[[ord("U"), ord("u")]] = 3
    out = table[np.frombuffer("".join(seqs).encode("ascii", "replace"), np.uint8)].reshape(len(seqs), -1)
    if (out == 255).any():
        raise ValueError(f"a read has another letter than A, C, G, T and U: {seqs[int((out == 255).any(1).argmax())]!r}")
    return out


def site_log_odds(codes: np.ndarray, comp: Component, q: np.ndarray) -> np.ndarray:
    """n x sites, natural logarithm."""
    m = codes.shape[1] - comp.width + 1
    out = np.zeros((len(codes), m))
    with np.errstate(divide="ignore"):
        for offset, t in comp.parts:
            logs = np.log(t) - np.log(q)[None, :, None]
            for j in range(t.shape[2]):
                cur = codes[:, offset + j : offset + j + m]
                prev = codes[:, offset + j - 1 : offset + j - 1 + m] if j else np.zeros_like(cur)
                out += logs[:, :, j].ravel()[prev * np.uint8(4) + cur]
    return out


def gated_counts(codes: np.ndarray, z: np.ndarray, seed: str, radius: int | None, grouped: bool) -> np.ndarray:
    """Weighted transitions of sites near a seed, (groups, 4, 4, k): all columns of sites with fewer mismatches than
    ``radius``, only mismatching columns of sites with as many; None counts all."""
    k, m = len(seed), z.shape[1]
    groups = max(1, radius) if grouped and radius is not None else 1
    out = np.zeros((groups, 16, k))
    ok = np.array([[b in bases_of(c) for b in "ACGT"] for c in seed])
    hd = np.zeros(z.shape, np.int16)
    for j in range(k):
        hd += ~ok[j][codes[:, j : j + m]]
    row, col = np.nonzero((z > 0) & ((hd <= radius) if radius is not None else True))
    z, hd, left, prev = z[row, col], hd[row, col], np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    for j in range(k):
        cur = codes[row, col + j].astype(np.int64)
        bad = ~ok[j][cur]
        w = z if radius is None else z * ((hd < radius) | ((hd == radius) & bad))
        out[:, :, j] += np.bincount(np.minimum(left, groups - 1) * 16 + prev * 4 + cur, w, groups * 16).reshape(groups, 16)
        left += bad if groups > 1 else 0
        prev = cur
    return out.reshape(groups, 4, 4, k)


class Kernel:
    """Sums of a round over reads of one length: what they are is laid out as named slices of one vector."""

    def __init__(self, state: State, cfg: Config):
        self.cfg, self.state = cfg, state
        self.comps = components(state, cfg)
        self.q = state.background
        self.lambda_bg = max(state.lambda_bg, 1e-300)
        self.groups = max(1, cfg.radius) if cfg.model == "adm-fixed" else 1
        self.slices: dict[tuple, tuple[slice, tuple[int, ...]]] = {}
        self.size = 0
        for key, shape in (("ll",), (1,)), (("ecll",), (1,)), (("n",), (1,)), (("signal",), (4,)):
            self._slot(key, shape)
        for c in self.comps:
            self._slot(("lambda", *c.key), (1,))
            if c.key[0] == "m":
                self._slot(("counts", *c.key), (self.groups, 4, 4, c.width))
                self._slot(("half", *c.key), (self.groups, 4, 4, c.width))
            elif c.key[3] <= cfg.max_gap:
                self._slot(("counts", *c.key), (self.groups, 4, 4, c.width))

    def _slot(self, key: tuple, shape: tuple[int, ...]) -> None:
        n = int(np.prod(shape))
        self.slices[key] = (slice(self.size, self.size + n), shape)
        self.size += n

    def get(self, sums: np.ndarray, *key) -> np.ndarray:
        s, shape = self.slices[key]
        return sums[s].reshape(shape)

    def posteriors(self, codes: np.ndarray) -> tuple[list[list[np.ndarray]], np.ndarray]:
        """([component][strand] n x sites, background's share)."""
        strands = [codes, 3 - codes[:, ::-1]] if self.cfg.two_strands else [codes]
        odds, denominator = [], np.full(len(codes), self.lambda_bg)
        for c in self.comps:
            m = codes.shape[1] - c.width + 1
            if m <= 0 or c.weight <= 0:
                odds.append(None)
                continue
            both = []
            for s, x in enumerate(strands):
                u = c.weight / (m * len(strands)) * np.exp(site_log_odds(x, c, self.q if s == 0 else self.q[::-1]))
                denominator += u.sum(1)
                both.append(u)
            odds.append(both)
        return [None if b is None else [u / denominator[:, None] for u in b] for b in odds], denominator

    def add(self, codes: np.ndarray, sums: np.ndarray) -> None:
        cfg, state = self.cfg, self.state
        n, length = codes.shape
        strands = [codes, 3 - codes[:, ::-1]] if cfg.two_strands else [codes]
        z, denominator = self.posteriors(codes)
        logq = np.log2(self.q)[codes].sum()
        self.get(sums, "n")[0] += n
        ll = np.log2(denominator).sum() + logq
        self.get(sums, "ll")[0] += ll
        share = self.lambda_bg / denominator
        plogp = (share * np.log2(share)).sum()
        cover = np.zeros((n, length + 1))
        sites = {k: [np.zeros((n, max(0, length - t.shape[2] + 1))) for _ in strands] for k, t in enumerate(state.models)}
        half, turned = ({k: [np.zeros_like(x) for x in both] for k, both in sites.items()} for _ in range(2))
        radius = cfg.radius if cfg.gate else None
        for c, both in zip(self.comps, z, strict=True):
            if both is None:
                continue
            for s, p in enumerate(both):
                m = p.shape[1]
                self.get(sums, "lambda", *c.key)[0] += p.sum()
                with np.errstate(divide="ignore", invalid="ignore"):
                    plogp += np.where(p > 0, p * np.log2(p), 0).sum()
                for offset, t in c.parts:
                    w = t.shape[2]
                    at = p if s == 0 else p[:, ::-1]
                    begin = offset if s == 0 else c.width - offset - w
                    cover[:, begin : begin + m] += at
                    cover[:, begin + w : begin + w + m] -= at
                if c.key[0] == "m":
                    sites[c.key[1]][s] += p
                    continue
                _, r, o, d = c.key
                pair = state.pairs[r]
                if d <= cfg.max_gap:
                    seed = pair.seeds.get((o, d)) or self.gap_seed(pair, o, d)
                    total = self.get(sums, "counts", *c.key)
                    if d < 0:
                        total += gated_counts(strands[s], p, seed, radius, self.groups > 1)
                    else:  # a site counts whole or not at all
                        total[:1] += gated_counts(strands[s], p, seed, None if radius is None else radius + 1, False)
                if d >= cfg.min_distance:
                    order = (pair.tf2, pair.tf1) if cfg.rna and o == "TH" else (pair.tf1, pair.tf2)
                    flips = (False, False) if cfg.rna else (o[0] == "T", o[1] == "H")
                    offset = 0
                    for tf, flip in zip(order, flips, strict=True):
                        w = state.models[tf].shape[2]
                        if flip:
                            high = length - w - offset
                            turned[tf][s][:, high - m + 1 : high + 1] += p[:, ::-1]
                        else:
                            half[tf][s][:, offset : offset + m] += p
                        offset += w + d
        self.get(sums, "ecll")[0] += ll + plogp
        cover = np.cumsum(cover[:, :-1], 1)
        self.get(sums, "signal")[:] += np.bincount(codes.ravel(), cover.ravel(), 4)
        for k, seed in enumerate(state.seeds):
            if length < state.models[k].shape[2]:
                continue
            total, parts = self.get(sums, "counts", "m", k), self.get(sums, "half", "m", k)
            for s, x in enumerate(strands):
                total += gated_counts(x, sites[k][s], seed, radius, self.groups > 1)
                if half[k][s].any():
                    parts += gated_counts(x, half[k][s], seed, radius, self.groups > 1)
                if turned[k][s].any():
                    parts += gated_counts(3 - x[:, ::-1], turned[k][s], seed, radius, self.groups > 1)

    def gap_seed(self, pair: Pair, o: str, d: int) -> str:
        """Halves' seeds with N in the gap and one column on both its sides."""
        a, b = oriented(self.state.seeds[pair.tf1], self.state.seeds[pair.tf2], o, self.cfg.rna, reverse_complement)
        return a[:-1] + "N" * (d + 2) + b[1:]

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(self.size)
        for batch in batches:
            seqs = batch.column(0).to_pylist()
            by_length: dict[int, list[str]] = {}
            for s in seqs:
                by_length.setdefault(len(s), []).append(s)
            for length, group in sorted(by_length.items()):
                if length:
                    for at in range(0, len(group), 4096):
                        self.add(encode(group[at : at + 4096]), sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(self.size)), pa.array(sums)], ["i", "v"])


def expectation(reads: DataFrame, state: State, cfg: Config) -> tuple[Kernel, np.ndarray]:
    """One round's sums: partial ones from each task, added up by Spark."""
    kernel = Kernel(state, cfg)
    rows = reads.select("seq").mapInArrow(kernel.run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(kernel.size)
    for r in rows:  # as many as the models have numbers
        sums[r["i"]] = r["v"]
    return kernel, sums


def pseudo_counts(cfg: Config, q: np.ndarray, k: int) -> np.ndarray:
    """(4, 4, k): added to counts; of an order-zero model the sum over the first base counts."""
    one = {"none": np.zeros(4), "addone": np.full(4, 1e-6), "dirichlet": 0.01 * q}[cfg.prior]
    return np.broadcast_to(one[None, :, None] / (4 if cfg.model == "ppm" else 1), (4, 4, k))


def estimate(counts: np.ndarray, seed: str, cfg: Config, q: np.ndarray) -> np.ndarray:
    """Transition tensor from grouped counts (groups, 4, 4, k)."""
    pseudo = pseudo_counts(cfg, q, counts.shape[3])
    if cfg.model == "ppm":
        return tensor(M.normalize_columns((counts.sum(0) + pseudo).sum(0)))
    if cfg.model == "adm-fixed" and len(counts) > 1:
        return A.Adm(A.correct_seed_bias([c + pseudo / len(counts) for c in counts], seed, cfg.radius)).t
    return A.Adm.from_counts(counts.sum(0) + pseudo).t


def model_distance(a: np.ndarray, b: np.ndarray, cfg: Config) -> float:
    return M.distance(ppm(a), ppm(b)) if cfg.model == "ppm" else A.Adm(a).distance(A.Adm(b))


def information(t: np.ndarray, cfg: Config, q=M.UNIFORM) -> float:
    return M.average_information_content(ppm(t), q) if cfg.model == "ppm" else float(A.Adm(t).information_content(q).mean())


def seed_of(t: np.ndarray, cfg: Config) -> str:
    return M.consensus(ppm(t)) if cfg.model == "ppm" else A.Adm(t).best_string()


def n_parameters(state: State, cfg: Config) -> int:
    each = 3 if cfg.model == "ppm" else 12
    n = 3 + sum(each * t.shape[2] - (0 if each == 3 else 9) for t in state.models) + len(state.lambdas)
    for p in state.pairs:
        live = [d for (_, d), x in p.lambdas.items() if x > 0]
        width = state.models[p.tf1].shape[2] + state.models[p.tf2].shape[2]
        n += len(live) + sum(each * min(abs(d) + 2, width) for d in live if d <= cfg.max_gap)
    return n


def initial_model(reads: DataFrame, seed: str, cfg: Config, q: np.ndarray) -> np.ndarray:
    """From single substitutions of the seed less the chance level (order zero), or from its neighbourhood (order one)."""
    k = len(seed)
    if cfg.model == "ppm":
        m = np.zeros((4, k))
        for r in C.snips_corrected(reads, seed, cfg.two_strands).collect():
            m["ACGT".index(r["base"]), r["col"]] = r["n"]
        return estimate(np.concatenate([m[None], np.zeros((3, 4, k))])[None], seed, cfg, q)
    groups = max(1, cfg.radius) if cfg.model == "adm-fixed" else 1
    counts = np.zeros((groups, 4, 4, k))
    hits = seed_hits(reads, seed, 2, cfg.two_strands)
    for r in C.dinucleotide_counts(hits, seed, 2, groups > 1).collect():
        counts[r["r"], "ACGT".index(r["prev"] or "A"), "ACGT".index(r["base"]), r["col"]] = r["n"]
    return estimate(counts, seed, replace(cfg, radius=2) if groups > 1 else cfg, q)


def dimer_grid(cfg: Config, i: int, j: int, k1: int, k2: int, lmin: int) -> Pair:
    """Cases of a pair: distances from -min(k) / 2 (at least -min(k) + 1) to dmax (at most what a read holds)."""
    small = min(k1, k2)
    dmin = max(-(small // 2) if cfg.dmin is None else cfg.dmin, -small + 1)
    dmax = min(cfg.dmax, lmin - k1 - k2)
    names = (("HT",) if i == j else ("HT", "TH")) if cfg.rna else ORIENTATIONS[:3] if i == j else ORIENTATIONS
    return Pair(i, j, names, dmin, dmax, {(o, d): 0.0 for o in names for d in range(dmin, dmax + 1)})


def initialize(reads: DataFrame, seeds: list[str], cfg: Config, matrices: list[np.ndarray] | None = None, meme_init: bool = False) -> State:
    seeds = [s.upper().replace("U", "T") for s in seeds]
    stats = {r["base"]: r["q"] for r in C.background(reads).collect()}
    q = np.array(cfg.freqs or [stats[b] for b in "ACGT"])
    if matrices:
        models = [tensor(np.array(m, float)) for m in matrices]
        seeds = [seed_of(t, cfg) for t in models]
    elif meme_init:
        models = [tensor(M.from_seed(s)) for s in seeds]
    else:
        models = [initial_model(reads, s, cfg, q) for s in seeds]
    p = len(models)
    cob = [(i, j) for i in range(p) for j in range(i, p)] if cfg.cob == "all" else list(cfg.cob)
    lmin = C.read_stats(reads).first()["lmin"] if cob else 0
    pairs = [dimer_grid(cfg, i, j, models[i].shape[2], models[j].shape[2], lmin) for i, j in cob]
    monomers = 0.3 if pairs else 1 - cfg.background_fraction
    cases = sum(len(x.lambdas) for x in pairs)
    for x in pairs:
        x.lambdas = dict.fromkeys(x.lambdas, (1 - cfg.background_fraction - monomers) / cases)
    state = State(models, seeds, [monomers / p] * p, q, pairs)
    adjust_pair_seeds(reads, state, pairs, cfg)
    return state


def adjust_pair_seeds(reads: DataFrame, state: State, pairs: list[Pair], cfg: Config) -> None:
    """Seeds of overlapping cases: the halves' combination, its overlap filled by the commonest completion. One job for all."""
    cases, wanted = [], []
    for pair in pairs:
        for (o, d), weight in pair.lambdas.items():
            if d < 0 and weight > 0:
                a, b = oriented(state.seeds[pair.tf1], state.seeds[pair.tf2], o, cfg.rna, reverse_complement)
                wanted.append((pair, o, d))
                cases.append((combine_overlap(a, b, d, cfg.combine), len(a) + d, -d))
    for (pair, o, d), (kmer, _) in zip(wanted, commonest_completions(reads, cases, cfg.two_strands, cfg.directional_seeds), strict=True):
        pair.seeds[o, d] = kmer


def maximization(state: State, cfg: Config, kernel: Kernel, sums: np.ndarray, totals: np.ndarray) -> State:
    """New parameters from a round's sums; ``totals`` are the base counts of all reads."""
    n = max(float(kernel.get(sums, "n")[0]), 1.0)
    lambdas = [float(kernel.get(sums, "lambda", "m", k)[0]) / n for k in range(len(state.models))]
    pairs = []
    for r, pair in enumerate(state.pairs):
        new = {c: float(kernel.get(sums, "lambda", "d", r, *c)[0]) / n if x > 0 else 0.0 for c, x in pair.lambdas.items()}
        pairs.append(replace(pair, lambdas=new, seeds=dict(pair.seeds), observed={}, deviation={}))
    rest = np.maximum(totals - kernel.get(sums, "signal"), 0) + (1e-6 if cfg.prior != "none" else 0)
    q = rest / rest.sum() if rest.sum() > 0 else state.background
    models = []
    for k, t in enumerate(state.models):
        apart = sum(x for p in pairs for tf in (p.tf1, p.tf2) if tf == k for (_, d), x in p.lambdas.items() if d >= cfg.min_distance)
        counts = kernel.get(sums, "half", "m", k) + (kernel.get(sums, "counts", "m", k) if apart < cfg.purely_modular else 0.0)
        models.append(t if k in cfg.fixed_monomers or not counts.any() else estimate(counts, state.seeds[k], cfg, q))
    out = State(models, list(state.seeds), lambdas, q, pairs)
    for r, pair in enumerate(pairs):
        for (o, d), weight in list(pair.lambdas.items()):
            if weight <= 0:
                continue
            if d > cfg.max_gap:
                if weight < cfg.cob_cutoff:
                    pair.lambdas[o, d] = 0.0
                continue
            counts = kernel.get(sums, "counts", "d", r, o, d)
            seed = pair.seeds.get((o, d)) or kernel.gap_seed(pair, o, d)
            observed = estimate(counts if d < 0 else counts.sum(0, keepdims=True), seed, cfg if d < 0 else replace(cfg, model="ppm" if cfg.model == "ppm" else "adm-unfixed"), q)
            w1 = state.models[pair.tf2 if cfg.rna and o == "TH" else pair.tf1].shape[2]
            weak = d < 0 and information(A.Adm(observed).cut(w1 + d - 1, 2 - d).t, cfg) < cfg.ic_threshold
            if weak or weight < cfg.cob_cutoff or not counts.any():
                pair.lambdas[o, d] = 0.0
                continue
            pair.observed[o, d] = observed
            first, last = (w1 + d, w1 - 1) if d < 0 else (w1, w1 + d - 1)
            dev = np.zeros_like(observed)
            dev[:, :, first - 1 : last + 2] = (observed - expected(out, pair, o, d, cfg))[:, :, first - 1 : last + 2]
            pair.deviation[o, d] = dev
    return out


def change(old: State, new: State, cfg: Config) -> float:
    """Largest distance over monomers and deviations."""
    d = [model_distance(a, b, cfg) for a, b in zip(old.models, new.models, strict=True)]
    for p, q in zip(old.pairs, new.pairs, strict=True):
        for c, dev in q.deviation.items():
            d.append(float(np.abs(dev - p.deviation.get(c, 0.0)).max()))
    return max(d, default=0.0)


def as_dna():
    """The column seq in capitals, with T for U; seeds and models are so too."""
    return F.translate(F.upper("seq"), "U", "T").alias("seq")


def fit(reads: DataFrame, seeds: list[str], cfg: Config = Config(), matrices: list[np.ndarray] | None = None, meme_init: bool = False) -> Result:
    """Learns from (read_id, seq). Reads shorter than a site take no part in it; an empty table raises."""
    reads = spread(reads.select("read_id", as_dna())).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        totals = np.array([r["n"] for r in sorted(C.background(reads).collect(), key=lambda r: r["base"])], float)
        if not totals.sum():
            raise ValueError("no reads")
        state = initialize(reads, seeds, cfg, matrices, meme_init)
        history: list[dict] = []
        frozen, pruned_at, seen = not cfg.adjust_seeds, 0, []
        for round_ in range(1, cfg.max_iter + 1):
            kernel, sums = expectation(reads, state, cfg)
            new = maximization(state, cfg, kernel, sums, totals)
            live = lambda s: sum(x > 0 for p in s.pairs for x in p.lambdas.values())
            pruned_at = round_ if live(new) < live(state) else pruned_at
            if not frozen:
                new.seeds = [seed_of(t, cfg) for t in new.models]
                for pair in new.pairs:
                    if set(new.seeds[pair.tf1]) == {"N"} or set(new.seeds[pair.tf2]) == {"N"}:
                        pair.lambdas = dict.fromkeys(pair.lambdas, 0.0)
                if new.seeds != state.seeds:
                    adjust_pair_seeds(reads, new, new.pairs, cfg)
            delta = change(state, new, cfg)
            ll = float(kernel.get(sums, "ll")[0])
            history.append({
                "round": round_, "ll": ll, "expected_ll": float(kernel.get(sums, "ecll")[0]), "n_params": n_parameters(new, cfg), "lambda_bg": new.lambda_bg, "lambdas": list(new.lambdas),
                "seeds": list(new.seeds), "avg_ic": [information(t, cfg, new.background) for t in new.models], "max_dist": delta,
            })
            seen = [*seen, (ll, list(state.seeds))][-cfg.oscillation_rounds :]
            state = new
            if delta < cfg.epsilon:
                return Result(state, history, True)
            if not frozen and round_ >= cfg.oscillation_from and round_ - pruned_at >= cfg.oscillation_rounds:
                state.seeds, frozen = max(seen)[1], True
        return Result(state, history, False)
    finally:
        reads.unpersist()


def unbound(reads: DataFrame, state: State, cfg: Config) -> DataFrame:
    """(read_id, seq) of the reads in which no component is as likely as the background."""
    kernel = Kernel(state, cfg)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column("seq").to_pylist()
            free = np.ones(len(seqs), bool)
            for length in set(map(len, seqs)) - {0}:
                at = np.array([i for i, s in enumerate(seqs) if len(s) == length])
                z, denominator = kernel.posteriors(encode([seqs[i] for i in at]))
                share = kernel.lambda_bg / denominator
                for both in z:
                    if both is not None:
                        free[at] &= sum(p.sum(1) for p in both) < share
            yield batch.filter(pa.array(free))

    return reads.select("read_id", "seq").mapInArrow(keep, reads.select("read_id", "seq").schema)


def site_posteriors(reads: DataFrame, state: State, cfg: Config) -> DataFrame:
    """(motif, strand, pos, z): posterior sums of monomer sites by where they start (from 1, forward), added up in each task."""
    kernel = Kernel(state, cfg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], float] = {}
        for batch in batches:
            seqs = batch.column(0).to_pylist()
            for length in set(map(len, seqs)) - {0}:
                z, _ = kernel.posteriors(encode([s for s in seqs if len(s) == length]))
                for c, both in zip(kernel.comps, z, strict=True):
                    if c.key[0] == "m" and both is not None:
                        for s, p in enumerate(both):
                            for j, v in enumerate(p.sum(0)[:: -1 if s else 1]):
                                total[c.key[1], s, j + 1] = total.get((c.key[1], s, j + 1), 0.0) + float(v)
        keys = list(total)
        cols = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([total[k] for k in keys], pa.float64())], ["motif", "strand", "pos", "z"])

    return reads.select("seq").mapInArrow(run, "motif int, strand int, pos int, z double").groupBy("motif", "strand", "pos").agg(F.sum("z").alias("z"))


def flanks(reads: DataFrame, state: State, cfg: Config) -> dict[tuple, np.ndarray]:
    """Of each motif and each live dimer case a 4 x (2 lmax - k) matrix, by the component's key: bases around its sites,
    weighted by posterior; the site is in the middle."""
    kernel = Kernel(state, cfg)
    lmax = C.read_stats(reads).first()["lmax"]
    shapes = {c.key: (4, 2 * lmax - c.width) for c in kernel.comps if c.width <= lmax}
    ends = dict(zip(shapes, np.cumsum([a * b for a, b in shapes.values()]), strict=True))
    size = max(ends.values(), default=0)

    def of(sums: np.ndarray, key: tuple) -> np.ndarray:
        a, b = shapes[key]
        return sums[ends[key] - a * b : ends[key]].reshape(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for batch in batches:
            seqs = batch.column(0).to_pylist()
            for length in set(map(len, seqs)) - {0}:
                codes = encode([s for s in seqs if len(s) == length])
                z, _ = kernel.posteriors(codes)
                for c, both in zip(kernel.comps, z, strict=True):
                    if both is None:
                        continue
                    m = of(sums, c.key)
                    for s, p in enumerate(both):
                        x = codes if s == 0 else 3 - codes[:, ::-1]
                        for j in range(p.shape[1]):
                            low = lmax - c.width - j
                            for i in range(length):
                                m[:, low + i] += np.bincount(x[:, i], p[:, j], 4)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(sums)], ["i", "v"])

    sums = np.zeros(size)
    for r in reads.select("seq").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r["i"]] = r["v"]
    return {key: M.normalize_columns(of(sums, key)) for key in shapes}


def seed_report(reads: DataFrame, state: State, cfg: Config) -> list[dict]:
    """How often the seeds of motifs and of live dimer cases occur, and would by chance; one job for all."""
    kernel, reads = Kernel(state, cfg), reads.select("read_id", as_dna())
    rows = [(str(k), "", 0, seed) for k, seed in enumerate(state.seeds)]
    for pair in state.pairs:
        rows += [(f"{pair.tf1}-{pair.tf2}", o, d, pair.seeds.get((o, d)) or kernel.gap_seed(pair, o, d)) for (o, d), x in pair.lambdas.items() if x > 0 and d <= cfg.max_gap]
    lengths = {r["n"]: r["count"] for r in reads.groupBy(F.length("seq").alias("n")).count().collect()}
    out = []
    for (motif, o, d, seed), n in zip(rows, pattern_counts(reads, [r[3] for r in rows], cfg.two_strands), strict=True):
        sites = sum(max(0, length - len(seed) + 1) * count for length, count in lengths.items())
        chance = sites * (2 if cfg.two_strands else 1) * len(neighbourhood(seed, 0, True)) * 4.0 ** -len(seed) if seed.count("N") < 8 else None
        out.append({"motif": motif, "orient": o, "d": d, "seed": seed, "observed": n, "expected": chance})
    return out
