"""DataFrame-to-DataFrame operators: statistics, rules, distances, imputers, encoders."""
