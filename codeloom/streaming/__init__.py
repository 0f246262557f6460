"""Part of codeloom: streaming."""
