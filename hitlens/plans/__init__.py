"""Composed jobs: the statistics tick / backfill, the query catalog and its SQL twins."""
