"""strandline: longitudinal presence, spatial and compositional analytics on PySpark.

The package has no import-time side effects.  Sub-packages:

``sources``     scans and sinks (string-first CSV, JSON, checkpoints, split writers)
``functions``   column-level helpers (tri-state flags, codes, tiles, mesh, text)
``operators``   DataFrame -> DataFrame operators
``plans``       named queries that bind the operators to the driver tables
``streaming``   Structured Streaming form of the checkpoint operators
``llm``         operators for training-data preparation (optional, self-contained)
"""

__version__ = "0.1.0"
