"""Training-data operators: de-duplication, packing, decontamination, language
identification and text cleaning as Spark jobs over a documents table.

Each operator takes DataFrames and column names and has its own general
interface; ``queries`` holds the thin registered queries.  Nothing outside
this subpackage imports it.
"""
