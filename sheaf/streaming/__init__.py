"""Streams: arriving documents, and windows over events."""
