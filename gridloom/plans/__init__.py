"""Index notation, lowered to joins and aggregations."""
