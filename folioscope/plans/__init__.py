"""Shared physical building blocks: staging, prefix sums, graph contraction."""
