"""Whole reports: compositions of operators, each one lazy plan over whole tables."""
