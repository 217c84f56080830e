"""Sources and sinks: test-table readers, fixtures, CSV / image / nested-array
inputs and table writers."""
