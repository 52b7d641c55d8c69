"""Table sources and sinks: Parquet, versioned snapshot tables, Iceberg, catalogs over REST, topic snapshots."""
