"""Plan helpers: durable intermediate tables, prefix sums, skew."""
