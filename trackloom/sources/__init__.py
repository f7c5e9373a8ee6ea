"""Readers, writers and views that give the tables the operators work on."""
