"""Clinical-trial registry analytics as Spark jobs.

``functions``  Column expressions (text, parsing, dates)
``sources``    readers for registry XML and stored registry tables
``operators``  DataFrame -> DataFrame operators (views, reports, insights, access)
``sinks``      delimited, JSON and snapshot outputs
``plans``      whole jobs: ingest, insight dataset, queries over the given tables
``streaming``  the ingest job fed by a file stream
"""
