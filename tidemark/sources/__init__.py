"""Readers of raw upstream text and writers of archive tables and exports."""
