"""judgelake: Spark jobs over tables of code changes and machine judgments.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing is collected to the driver and no table is broadcast by hint:
join strategies are left to the optimizer, which only broadcasts below
``spark.sql.autoBroadcastJoinThreshold``.
"""

__version__ = "0.1.0"
