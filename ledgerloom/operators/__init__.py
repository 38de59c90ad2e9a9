"""Rules and aggregations that the plans are made of."""
