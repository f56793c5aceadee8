"""Tessella: a spreadsheet-style analytics engine on PySpark DataFrames."""
