"""Training-data operators for text: nothing else in the library imports this subpackage.

Every operator is a function ``DataFrame -> DataFrame``. It reads only the key and the
text columns that its arguments name, so that extra input columns, also such as have the
name of a result column, never clash with the result.
"""
