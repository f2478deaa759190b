"""Behaviour analytics, dataset governance and detector evaluation as Spark plans."""
