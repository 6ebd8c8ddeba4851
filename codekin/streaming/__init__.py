"""Streaming forms of the long-lived workers."""
