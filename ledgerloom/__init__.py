"""Reconciliation of two transaction tables that reference each other, as Spark plans."""
