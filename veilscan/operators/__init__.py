"""DataFrame operators: detection, findings, classification, reports, profile."""
