"""Roster-decision analytics and corpus preparation as Spark plans."""
