"""graphspark: graph analytics and corpus preparation as declarative Spark plans."""
