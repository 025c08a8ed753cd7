"""DataFrame-in, DataFrame-out jobs over graphs, intervals, hierarchies, matrices and text."""
