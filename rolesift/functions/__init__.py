"""Column packs: pure Column -> Column functions, no Spark session needed."""
