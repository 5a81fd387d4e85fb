"""Training-data operators. Nothing else in the library imports this subpackage.

Each module holds one operator with its own general interface; ``registry`` holds
the thin queries that apply them to the tables of a folder.
"""
