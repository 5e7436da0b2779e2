"""Training-data operators: ten components that share one chunk format.

Nothing outside this subpackage imports it.
"""
