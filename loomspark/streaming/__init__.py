"""Windows, sessions and dedup over event streams; the same functions serve batches."""
