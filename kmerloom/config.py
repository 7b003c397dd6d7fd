"""Default parameters of each step."""

from __future__ import annotations

from dataclasses import dataclass

# Terms that make a label too vague to train on.
AMBIGUOUS_TERMS = ("uncultured", "unidentified", "unclassified", "environmental sample", "metagenome", "sp.", "candidatus", "incertae sedis", "unknown")
ALPHABET = "ACGU"


@dataclass(frozen=True)
class Cleaning:
    min_len: int = 1000
    max_len: int = 1200
    max_n_frac: float = 0.01
    terms: tuple[str, ...] = AMBIGUOUS_TERMS
    word_boundary: bool = False  # "sp." as a word of its own instead of any substring
    normalize_t: bool = False  # read T as U before anything else
    dedup: str = "forward"  # or "both": whether reverse complements are duplicates too
    strand: str = "both"  # or "forward": which strands nested sequences are looked for on
    chimeras: str = "skip"  # or "denovo", or "vsearch" where executors have that program
    skew: float = 2.0  # how many times as abundant a chimera's parents are
    least_segment: int = 32  # letters of a chimera that come from each parent, at least


@dataclass(frozen=True)
class Kmers:
    k: int = 6
    alphabet: str = ALPHABET


@dataclass(frozen=True)
class Splitting:
    test: float = 0.2
    val: float = 0.2
    seed: int = 42
    folds: int = 5


@dataclass(frozen=True)
class Profiling:
    near_zero_variance: float = 1e-5
    sparse_fraction: float = 0.99
    correlated: float = 0.98
    heatmap_features: int = 50


@dataclass(frozen=True)
class Reducing:
    cutoff: float = 0.95
    network: float = 0.85
    method: str = "pearson"
    plot_features: int = 60


@dataclass(frozen=True)
class Forest:
    trees: int = 300
    depth: int = 10
    min_leaf: int = 5
    seed: int = 42


@dataclass(frozen=True)
class Boosting:
    rounds: int = 200
    depth: int = 6
    rate: float = 0.1
    subsample: float = 0.8
    columns: float = 0.8
    patience: int = 10
    seed: int = 42
    l1: float = 0.3
    l2: float = 1.0
    least_child: float = 1.0  # Hessian on each side of a split
    least_gain: float = 1e-6
    bins: int = 64
