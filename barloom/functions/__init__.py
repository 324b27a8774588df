"""Column expressions: scalars, rolling frames, exponential weighting."""
