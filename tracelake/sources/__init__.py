"""Readers, sinks and adapters from stored tables to the trace model."""
