"""Default parameters of the pipeline, as frozen dataclasses.

The numbers are the documented defaults of the behaviour we reproduce; they
are plain job arguments and can be overridden with ``dataclasses.replace``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The defaults below (50000-entry vocabulary with [PAD]=0 and
# [UNK]=1, 64 tokens, 300-wide word vectors padded to 768, batches of 30,
# 60 labels before clustering, k=5, seed 42, 50 reduced dimensions, density
# sizes max(10, int(0.02 n)) and max(5, int(0.01 n)), at least 5 rows) must
# equal the reproduced behaviour's for the same results.


@dataclass(frozen=True)
class VocabSettings:
    min_freq: int = 1
    max_size: int = 50000          # includes the two special entries
    max_length: int = 64           # tokens kept per text before padding
    pad_token: str = "[PAD]"
    unk_token: str = "[UNK]"
    pad_id: int = 0
    unk_id: int = 1


@dataclass(frozen=True)
class VectorSettings:
    word_dim: int = 300            # width of a word-vector file
    out_dim: int = 768             # width at the edge (zero padded / cut)
    norm_eps: float = 1e-12


@dataclass(frozen=True)
class TagSettings:
    batch_size: int = 30           # texts per labeller call
    min_labels_to_cluster: int = 60
    reasoning_flag: str = "</think>"
    max_label_words: int = 5


@dataclass(frozen=True)
class ClusterSettings:
    kmeans_k: int = 5
    kmeans_method: str = "lloyd"   # or "minibatch": fewer passes over large tables
    seed: int = 42
    reduced_dims: int = 50
    default_algo: str = "both"
    # density clustering: min_cluster_size = max(10, int(0.02 n)),
    # min_samples = max(5, int(0.01 n)); fewer than 5 rows -> all noise
    min_cluster_floor: int = 10
    min_cluster_frac: float = 0.02
    min_samples_floor: int = 5
    min_samples_frac: float = 0.01
    min_rows_density: int = 5


@dataclass(frozen=True)
class Settings:
    vocab: VocabSettings = field(default_factory=VocabSettings)
    vectors: VectorSettings = field(default_factory=VectorSettings)
    tags: TagSettings = field(default_factory=TagSettings)
    cluster: ClusterSettings = field(default_factory=ClusterSettings)


DEFAULTS = Settings()
