"""Compositions: staging, marts, reports, guarded queries and the daily run."""
