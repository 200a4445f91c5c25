"""Plans built from the operators: verification, audits, constraints, query catalog."""
