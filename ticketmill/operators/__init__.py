"""Operators that reports and jobs are built from."""
