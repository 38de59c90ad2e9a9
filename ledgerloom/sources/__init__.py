"""Source tables: sheets, files, generated rows, views over order tables."""
