"""Micro-batch variants and their batch equivalents."""
