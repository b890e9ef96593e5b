"""Cohorts, features, labels and evaluation tables from event data, as lazy Spark plans."""
