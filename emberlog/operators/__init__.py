"""Operators on tables of entries."""

from emberlog.operators.fold import as_of, compacted, get, get_many, merge_runs, merge_tagged, newest_wins, run_statistics, scan, shadowed_by_deletes, visible

__all__ = ["as_of", "compacted", "get", "get_many", "merge_runs", "merge_tagged", "newest_wins", "run_statistics", "scan", "shadowed_by_deletes", "visible"]
