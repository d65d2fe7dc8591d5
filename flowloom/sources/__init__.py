"""Sources and sinks: capture files, rule files, knowledge documents."""
