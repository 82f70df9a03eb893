"""Sources and sinks: C trees, the stored index, ground truth, reports."""
