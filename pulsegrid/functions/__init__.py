"""Column-level building blocks: pure functions from Column to Column."""
