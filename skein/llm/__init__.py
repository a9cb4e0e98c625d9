"""Operators for preparing training and evaluation text at scale.

Nothing outside this subpackage imports it; it may be removed without
affecting the rest of the library.
"""
