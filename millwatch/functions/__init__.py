"""Column expressions: numeric guards, component scores, risk and alert rules."""
