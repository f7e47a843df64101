"""Sources and sinks: parquet tables, delimited registries, saved question sets."""
