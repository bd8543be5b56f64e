"""Column expressions: boxes, geometries, quadkeys and projections."""
