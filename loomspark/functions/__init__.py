"""Column functions and running computations that operators share."""
