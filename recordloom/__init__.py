"""A PySpark engine for record streams: fold a change log into keyed records, query and publish it."""
