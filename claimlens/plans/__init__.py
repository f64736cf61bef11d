"""Registered queries, their oracle SQL, the fixture mapping and the batch pipeline."""
