"""Point-in-time cross-sectional ranking and portfolio analytics as Spark DataFrame transformations."""
