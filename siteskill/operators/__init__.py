"""DataFrame operators: joins, ordered scans, quantiles, scores, bins, runs, densities."""
