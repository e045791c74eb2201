"""Tuning of a store."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class StoreConfig:
    """Thresholds that decide when buffered entries become runs and when levels are merged.

    Defaults suit Parquet on a cluster. ``StoreConfig.small()`` has the values of an embedded store, for tests.
    """

    #: Bytes of keys and values that the active buffer may hold before it is frozen.
    max_active_memtable_size: int = 64 << 20
    #: Frozen buffers that may wait before they are flushed.
    max_frozen_memtables: int = 1
    #: Parquet row groups are about so large.
    block_max_size: int = 32 << 20
    #: Level n may hold this times 10**n bytes before it is merged into level n + 1.
    level_base_max_size: int = 1 << 30
    #: Level n is meant to have this times 2**n files.
    level_base_max_sstables: int = 8

    @classmethod
    def small(cls) -> "StoreConfig":
        return cls(max_active_memtable_size=1 << 20, block_max_size=4 << 10, level_base_max_size=10 << 20, level_base_max_sstables=2)

    def level_max_size(self, level: int) -> int:
        return self.level_base_max_size * 10**level

    def level_max_sstables(self, level: int) -> int:
        return self.level_base_max_sstables * 2**level

    def level_for(self, size: int) -> int:
        """The first level that may hold so many bytes."""
        level = 0
        while self.level_max_size(level) < size:
            level += 1
        return level

    def target_shard_size(self, level: int) -> int:
        """Bytes that a file of ``level`` should hold."""
        return max(1, self.level_max_size(level) // self.level_max_sstables(level))
