"""emberlog: a keyed, versioned, tombstone-aware store and query layer on Spark."""
