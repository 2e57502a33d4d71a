"""Plans: the import job, the verification job and the registered queries."""
