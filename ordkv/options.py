"""Options of a store."""

from __future__ import annotations

from dataclasses import dataclass, fields

from .errors import InvalidError


@dataclass(frozen=True)
class Options:
    memtable_bytes: int = 4 << 20
    #: Size of a Parquet page, the least that is read of a run; and of the blocks of foreign run files.
    block_bytes: int = 64 << 10
    #: Sets the share of false positives of each file's filter over its keys; 0 writes none.
    bloom_bits_per_key: int = 10
    l0_trigger: int = 4
    level_multiplier: int = 10
    sync: bool = True
    #: Caps of sessions: pairs of a scan page, bytes of a transaction, bytes of a frame.
    max_scan_page: int = 10_000
    max_tx_bytes: int = 64 << 20
    max_frame_bytes: int = 8 << 20
    #: Seconds in which a frame that has begun must be whole; a connection between frames may idle.
    max_frame_seconds: int = 30
    #: A single write larger than this is refused, as replay would take it for damage.
    max_record_bytes: int = 64 << 20
    #: Catalog versions whose runs vacuum keeps.
    keep_versions: int = 10
    #: About how much a compacted file holds: many buffers, so that neither files nor steps are as many as flushes.
    target_file_bytes: int = 128 << 20

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name != "sync" and (not isinstance(v, int) or v < (0 if f.name == "bloom_bits_per_key" else 2 if f.name == "level_multiplier" else 1)):
                raise InvalidError(f"{f.name} = {v!r}")

    def level_budget(self, level: int) -> int:
        """Bytes that a level from 1 down may hold."""
        return self.memtable_bytes * self.l0_trigger * self.level_multiplier ** (level - 1)
