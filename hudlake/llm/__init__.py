"""Operators for preparing a training corpus. Nothing outside this subpackage imports it."""
