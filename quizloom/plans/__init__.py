"""End-to-end plans over the fixture tables (what ``__spark_entry__`` registers)."""
