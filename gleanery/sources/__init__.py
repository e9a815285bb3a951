"""Readers for pages, sitemaps, robots rules, API answers and job files."""
