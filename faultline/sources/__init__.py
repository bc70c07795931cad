"""Sources and sinks: raw events, tables, documents, chunks, feedback, sync state."""
