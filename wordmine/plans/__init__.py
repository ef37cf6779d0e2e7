"""Whole analyses built from the operators, and utilities for long plans."""
