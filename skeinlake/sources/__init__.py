"""Sources and sinks: file trees, snapshot tables, evaluation sets, reports and notes."""
