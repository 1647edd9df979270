"""Training-data operators: ten self-contained modules, one per operator.

Nothing outside this subpackage imports it.  ``catalog`` lists the queries that
``__spark_entry__`` registers; each operator module keeps a general interface
and a thin ``opN_*`` query.
"""
