"""Operators: DataFrame in, DataFrame out; none collects inside but where stated."""
