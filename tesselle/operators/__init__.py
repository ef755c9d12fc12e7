"""Operators from pixel and mask relations to others."""
