"""Concentration-discharge water-quality analytics as PySpark DataFrame operators."""
