"""What a table means and which questions that meaning suggests."""
