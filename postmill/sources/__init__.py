"""Readers and writers: landed pages, tables, CSV/JSON exports, dead letters."""
