"""Sources and sinks of logs."""
