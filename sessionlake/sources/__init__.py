"""Readers, writers and the telemetry adapter."""
