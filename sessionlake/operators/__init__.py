"""Operators on event, session, state and risk tables."""
