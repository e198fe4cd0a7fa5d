"""Models, tuning, reports and end-to-end workflows."""
