"""Spindrift: corpus and evidence analytics as Spark DataFrame transformations."""
