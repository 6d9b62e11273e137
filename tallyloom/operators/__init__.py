"""DataFrame operators: facts, validation, deduplication, retrieval, synthesis, rollouts, audits."""
