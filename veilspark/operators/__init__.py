"""Guarded sessions, the policy classifier, coverage and limits."""
