"""Plan helpers: sessions and lineage cuts."""
