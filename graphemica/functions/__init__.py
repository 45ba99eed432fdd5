"""Scalar and array functions, as column builders."""
