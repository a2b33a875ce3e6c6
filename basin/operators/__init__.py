"""DataFrame operators: table write rules, line edits, topology, fleet status, retention, text semantics."""
