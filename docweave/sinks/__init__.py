"""Stores that Spark writes: keyed tables, and batches that go to several of them."""
