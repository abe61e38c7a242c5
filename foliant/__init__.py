"""Foliant: analytics over scholarly-paper catalogues, written as Spark DataFrame operators."""
