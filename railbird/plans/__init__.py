"""Query products made of operators, and the catalogue of queries with their SQL twins."""
