"""Flows of a packet stream."""
