"""Query jobs and the registered queries (each with an equivalent SQL for an independent check)."""
