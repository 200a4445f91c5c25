"""Sources and sinks: table sets, appended batches, JSON-lines, record bags, run results, generation."""
