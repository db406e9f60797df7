"""Operators over tables of graphs."""
