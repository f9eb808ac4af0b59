"""opslens: operations analytics expressed as Spark DataFrame jobs.

Layout:
  sources/    readers and report parsers (JSON, text, binary files, job messages)
  functions/  Column -> Column helpers (text, paths, severities, formats)
  operators/  DataFrame -> DataFrame operators (anomaly, timeline, capacity, ...)
  plans/      registered queries over the driver tables plus their SQL oracles
  streaming/  Structured Streaming twins of the batch operators
  sinks/      writers (reports, exposition text, payload rows)
"""

__version__ = "0.1.0"
