"""Résumé-document analytics on Spark."""
