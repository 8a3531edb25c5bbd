"""Operators of a training-data pipeline over document, page and vector tables.

Nothing outside this subpackage imports it.  Rules that every operator shares:

* an operator reads only the columns it is told to read, so extra columns,
  whatever their names, are ignored; its output columns are the key column
  and the ones its docstring lists;
* empty tables give empty results with the same columns;
* intermediate tables are written below ``spark.checkpoint.dir``.
"""
