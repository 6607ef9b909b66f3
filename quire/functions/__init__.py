"""Scalar functions: wildcards, the stack and infix expression language, string editing, calendar time."""
