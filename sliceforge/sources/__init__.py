"""Sources: corpus readers and readers of the job's own tables."""
