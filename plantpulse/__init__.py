"""Condition monitoring for machine fleets as Spark DataFrame operators."""
