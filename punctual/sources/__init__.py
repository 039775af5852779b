"""Reading, normalising and writing the order and delivery tables."""
