"""Operations of a training-data pipeline, each a DataFrame job.

Nothing outside this subpackage imports it; ``queries.QUERIES`` and
``queries.ORACLE_SQL`` are what the entry module registers.
"""
