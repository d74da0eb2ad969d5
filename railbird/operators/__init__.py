"""Operators on racing tables: DataFrame in, DataFrame out, nothing collected."""
