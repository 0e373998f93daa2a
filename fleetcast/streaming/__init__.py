"""Structured Streaming forms of the SCADA operators."""
