"""Where the logical tables come from and where results go."""
