"""Sources and sinks: landed files, catalog tables, JDBC, topics, config files, event logs."""
