"""Sinks: table writers and JSON / text export."""
