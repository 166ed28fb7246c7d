"""Library hygiene analytics on Spark: duplicates, contacts, sessions, quality, storage."""
