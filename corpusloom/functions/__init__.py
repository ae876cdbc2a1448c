"""Column expressions and the few vectorised functions that built-in expressions cannot give."""
