"""Session-level plumbing shared by the operators."""
