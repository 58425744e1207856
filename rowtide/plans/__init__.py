"""File-level planning: states, runs, windows of deletes, commit plans."""
