"""Readers, sinks and the test-table adapter."""
