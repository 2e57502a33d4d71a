"""DataFrame operators: chunking, statistics, validation, verification,
manifest / versions / runs, record changes."""
