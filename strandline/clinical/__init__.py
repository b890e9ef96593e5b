"""Perioperative cohorts: code tables, and preparation from raw tables to cohort, scores, labels and series."""
