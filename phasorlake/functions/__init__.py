"""Column algebra on arrays and the numerical helpers that the fits need."""
