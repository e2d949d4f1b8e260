"""Reading market tables; writing results, experiments and models."""
