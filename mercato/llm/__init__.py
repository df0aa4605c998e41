"""Training-data pipeline operators (tokenising, extraction, filtering,
near-duplicates, sharding).  Nothing else in the library imports this package."""
