"""Streaming: continuous import of new files (micro-batches of the batch plan)."""
