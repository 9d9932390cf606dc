"""paritas: table parity and SAS-semantics operators expressed as Spark jobs.

Sub-packages
------------
functions  column expressions (value match, row encoding, SAS scalar rules)
sources    readers, landing normalization, fingerprints and snapshots
operators  DataFrame operators (parity, SAS steps, ordered scans, state, reports, corpus)
plans      the registered query set built from the given tables
streaming  nothing in the source project streams; see its docstring
"""

__version__ = "0.1.0"
