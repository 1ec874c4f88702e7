"""Inventory data work on Spark: snapshot diff, car-string parsing, library
indexing, entity resolution, catalog matching and evidence merging."""
