"""Behaviour analytics over identity-tagged event logs, as Spark jobs."""
