"""Registered queries over the tables of a warehouse folder."""
