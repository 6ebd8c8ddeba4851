"""Plan-level helpers: scratch tables that cut lineage, session defaults."""
