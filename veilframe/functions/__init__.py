"""Scalar functions: key derivation on the driver, envelopes, normalizers and blind indexes as columns."""
