"""All registered queries of the districting engine."""

from wardline.plans import formats, measures, programs, records

QUERIES = measures.QUERIES | programs.QUERIES | records.QUERIES | formats.QUERIES
ORACLE_SQL = measures.ORACLE_SQL | programs.ORACLE_SQL | records.ORACLE_SQL | formats.ORACLE_SQL
