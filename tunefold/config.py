"""Configurations with validation, and the adaptive iteration limit."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CorpusConfig:
    min_songs: int = 10
    max_songs: int = 300
    max_tokens: int = 384  # the last one is the end mark
    train_share: float = 0.98
    val_share: float = 0.01
    seed: int = 42


@dataclass(frozen=True)
class HierarchyConfig:
    """Three layers of residual quantization. ``layer_clusters`` differing from ``need_clusters`` only picks the strategy of
    a layer: a middle layer has ``need`` centers in each parent whatever its ``layer_clusters``."""

    layer_clusters: tuple[int, ...] = (128, 128, 256)
    need_clusters: tuple[int, ...] = (128, 128, 256)
    embedding_dim: int = 512
    group_dims: tuple[int, ...] = (512,)
    hierarchical_weights: tuple[tuple[float, ...], ...] | None = None
    iter_limit: int = 100
    normalize_residuals: bool = True
    seed: int = 42
    weights: tuple[tuple[float, ...], ...] = field(init=False)

    def __post_init__(self) -> None:
        layers, groups = len(self.layer_clusters), len(self.group_dims)
        if len(self.need_clusters) != layers:
            raise ValueError("need_clusters and layer_clusters differ in length")
        if sum(self.group_dims) != self.embedding_dim:
            raise ValueError("group_dims must sum to embedding_dim")
        w = self.hierarchical_weights
        if w is None:
            w = tuple(tuple(1.0 / groups for _ in range(groups)) for _ in range(layers))
        if len(w) != layers:
            raise ValueError("hierarchical_weights need one row per layer")
        if any(len(r) != groups for r in w):
            raise ValueError("hierarchical_weights need one weight per group")
        object.__setattr__(self, "weights", tuple(tuple(float(x) for x in r) for r in w))


# Fixed values: (rows below, factor of the base limit, least limit).
_STEPS = ((5_000, 0.2, 10), (10_000, 0.3, 15), (50_000, 0.5, 30), (100_000, 0.7, 50), (500_000, 1.0, 0), (1_000_000, 1.2, 0))
# Fixed values for clusters inside a parent: (rows below, limit).
_SUB_STEPS = ((5_000, 15), (10_000, 20), (20_000, 25))


def iteration_limit(rows: int, clusters: int, layer: int, base: int, sub: bool = False) -> int:
    """How many k-means rounds a fit gets, from its rows, clusters, zero-based layer and the base limit."""
    per = rows / max(clusters, 1)
    if sub:
        limit = next((x for n, x in _SUB_STEPS if rows < n), 30)
        factor, least = (0.8, 10) if per < 50 else (1.2, 0) if per > 200 else (1.0, 0)
        return max(10, least, int(limit * factor))
    limit = next((max(least, int(f * base)) for n, f, least in _STEPS if rows < n), int(1.5 * base))
    limit = int(limit * (1.3 if clusters > 512 else 1.15 if clusters > 256 else 1))
    if layer > 1:
        limit = max(10, int(limit * 0.9))
    return max(10, int(limit * 1.2) if per < 50 else limit)
