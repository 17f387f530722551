"""Column functions and the per-row detectors."""
