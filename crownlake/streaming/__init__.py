"""The engine has no streaming operators: its operators are batch plans over whole clouds and tables.

Row-wise ones (colour filters, name cleaning, projections) are plain DataFrame transformations and so
run on streams too, as ``tests/test_sources.py`` shows for the green-point filter.
"""
