"""Quernstone: rule-based trading research as PySpark DataFrame programs."""
