"""DataFrame to DataFrame steps; each function adds to a plan and starts no job unless it says so."""
