"""quarry: document retrieval analytics as Spark DataFrame jobs.

Subpackages
-----------
sources    table and file readers, sinks, path resolution, de-duplication
functions  small column expressions (paths, URLs, previews, tokens)
operators  chunking, conversion, enrichment, embedding, indexing,
           retrieval, chat shaping and evaluation, each a DataFrame -> DataFrame
plans      composed jobs (ingest, answer, evaluate) and the registered checks
streaming  incremental ingest with Structured Streaming
"""

__version__ = "0.1.0"
