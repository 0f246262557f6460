"""Part of codeloom: operators."""
