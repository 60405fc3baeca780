"""Settings and table schemas."""

from __future__ import annotations

from dataclasses import dataclass

NODES = "node_id long, label string, properties map<string,string>, created timestamp"
EDGES = "edge_id long, from_node long, to_node long, relation string, weight double, created timestamp"
VECTORS = "vec_id long, embedding array<float>, metadata binary, created timestamp, deleted boolean"
KV_LOG = "seq long, ts timestamp, k string, v binary, ttl int, op string"
WAL = "lsn long, op string, layer string, entity_key string, payload string, crc long"

#: Decimals of distances and scores as they are returned.
FLOAT_DIGITS = 6


@dataclass(frozen=True)
class Config:
    """Limits and defaults; capacities count entries of 4 KiB."""

    dimension: int = 1536
    space: str = "cosine"
    max_context_tokens: int = 4096
    similarity_weight: float = 0.6
    recency_weight: float = 0.25
    importance_weight: float = 0.15
    decay_days: int = 30
    candidates: int = 50
    merge_strategy: str = "union"
    max_snapshots: int = 7
    hot_capacity: int = 2048 * 2**20 // 4096
    warm_capacity: int = 51200 * 2**20 // 4096
    max_key_bytes: int = 512
    max_value_bytes: int = 10 * 2**20
    small_file_bytes: int = 2**20
    wal_segment_entries: int = 1_000_000
    wal_segments_kept: int = 3
    kv_retention_days: int = 7
    #: Share of missing rows in an index's files beyond which it is rebuilt, and the rows a file should hold.
    index_fragmentation_threshold: float = 0.3
    index_file_rows: int = 1_000_000
    #: Bytes of a query block's components that may be broadcast.
    broadcast_bytes: int = 64 * 2**20

    @classmethod
    def from_toml(cls, path: str) -> Config:
        """Settings of a TOML file; sections are flattened and unknown names are errors."""
        import tomllib
        from dataclasses import fields

        with open(path, "rb") as f:
            data = tomllib.load(f)
        flat: dict = {}
        for name, value in data.items():
            flat |= value if isinstance(value, dict) else {name: value}
        known = {f.name for f in fields(cls)}
        if unknown := sorted(flat.keys() - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**flat)
