"""DataFrame-to-DataFrame operators; every threshold is an argument."""
