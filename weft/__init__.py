"""weft: iterative graph, sort, clustering, tuning and corpus operators as PySpark programs."""
