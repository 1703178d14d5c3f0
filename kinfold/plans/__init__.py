"""Plan-level helpers: staging tables, prefix sums and the registered queries."""
