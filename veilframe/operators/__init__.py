"""Operators over DataFrames: encrypting, decrypting, searching, writing, re-encrypting."""
