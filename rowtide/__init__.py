"""rowtide: a PySpark-native engine for merge-on-read tables and training-data pipelines.

``operators``  joins, windows, aggregations and the large-scale table operators
``sources``    table catalog, file scans, delete-file and puffin readers and writers
``functions``  hex, key codecs, bitmaps, canonical spellings
``plans``      watermark states, runs, the walk planner, commit plans
``streaming``  the conversion loop and the streaming upsert ingest
``queries``    named queries with their SQL twins
``llm``        text operators (optional; nothing outside imports it)
"""

__version__ = "0.1.0"
