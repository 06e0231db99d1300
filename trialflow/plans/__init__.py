"""Trial plans: expansion, ordering, completeness, resume."""
