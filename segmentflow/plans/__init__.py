"""Whole jobs, reports and registered queries."""
