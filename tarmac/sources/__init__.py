"""Sources: readers, imports, snapshots and sinks."""
