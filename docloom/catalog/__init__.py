from docloom.catalog.oracle import ORACLE_SQL
from docloom.catalog.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
