"""Part of codeloom: sources."""
