"""Sources and sinks: syntax, documents, files."""
