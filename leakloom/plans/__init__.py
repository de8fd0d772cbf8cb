"""Rules as data, and their compilation into plans."""
