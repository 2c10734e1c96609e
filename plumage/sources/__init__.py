"""Readers, online connectors with injected transports, and writers."""
