"""Operators for preparing large text and vector corpora.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; intermediate tables go to the shared folder of ``shared.work_dir``.
"""
