"""Variational forms as DataFrame plans."""
