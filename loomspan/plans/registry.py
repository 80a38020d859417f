"""All queries of the library by name, with the SQL that gives the same rows."""

from loomspan.plans import relational, texts, vectors
from loomspan.plans._base import QUERIES, SQL

FLAGSHIP = vectors.retrieval_pipeline

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "relational", "texts", "vectors"]
