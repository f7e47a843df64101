"""Independent DuckDB SQL for each registered query (the correctness oracle).

The SQL is written from the operator *specifications*, not generated from the
Spark plans; shared pieces (the fixture registry, the hash uniform) are small
string helpers.
"""
