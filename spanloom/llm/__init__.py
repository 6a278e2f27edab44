"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it.  Each operator module keeps a general interface (tables and
column names are arguments); ``queries`` binds the operators to the driver's tables.
"""
