"""Runnable jobs over tables of records."""
