"""checkwise — weighted yes/no checklist scoring on Spark.

Everything is a DataFrame plan built from Spark's own operators:

* ``sources``   — canonical tables derived from the input parquet, raw-shaped
                  inputs (submission JSON, history JSON Lines, headered CSV text)
                  and their readers.
* ``functions`` — Column -> Column helpers (dates, check parsing, scoring).
* ``operators`` — reusable relational building blocks (first-wins dedup,
                  insert-ignore, wildcard lookup, sequence numbering, sizing).
* ``plans``     — the user-level operations: reports, config, ingest, imports,
                  completeness, snapshot.
* ``streaming`` — ``foreachBatch`` wiring of the batch ingest.
* ``api``       — ``KpiStore``: the reference's operations over a folder of
                  stored tables.
"""

__version__ = "0.1.0"
