"""A run's settings, checked before anything is read."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RunConfig:
    """Images come from a folder, or from shards if use_shards is set."""

    data_dir: str | None = None
    use_shards: bool = False
    shard_dir: str | None = None
    batch_size: int = 32
    epochs: int = 50
    n_global: int = 2
    n_local: int = 8
    image_side: int = 224
    k: int = 20
    probe_every: int = 5
    save_every: int = 10

    def __post_init__(self) -> None:
        if self.use_shards and not self.shard_dir:
            raise ValueError("shard_dir is needed with use_shards")
        if not self.use_shards and not self.data_dir:
            raise ValueError("data_dir is needed unless use_shards is set")
        if self.batch_size < 1 or self.epochs < 1 or self.n_global < 1 or self.n_local < 0:
            raise ValueError("batch_size, epochs and n_global are at least 1, n_local at least 0")

    def steps(self, n_samples: int) -> int:
        """Full batches in an epoch."""
        if n_samples < self.batch_size:
            raise ValueError(f"{n_samples} samples don't fill a batch of {self.batch_size}")
        return n_samples // self.batch_size
