"""Validators: one plan per table type."""
