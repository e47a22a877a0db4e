"""Network-measurement analytics as DataFrame functions."""
