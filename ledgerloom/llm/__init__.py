"""Training-data operators on Spark.

Each module holds one operator with its general interface; ``queries`` holds the thin
registered queries that apply them to whole tables. Nothing else in the library imports
this subpackage.
"""
