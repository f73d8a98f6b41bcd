"""Sources and sinks: table readers, JDBC, footers, Delta logs, listings."""
