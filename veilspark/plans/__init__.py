"""Analysis of statements: gates, provenance, safety, lineage, posture, planning."""
