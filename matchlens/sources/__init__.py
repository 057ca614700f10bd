"""Readers, sinks and the test-table views."""
