"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; the driver's entry module
adds its queries only when the subpackage is present.
"""
