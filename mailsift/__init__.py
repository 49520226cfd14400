"""mailsift: message triage as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns) so that
Catalyst sees one plan per job: filters reach the Parquet scan, unread
columns are pruned, and shuffles happen only on the keys of joins and
groupings.
"""

__version__ = "0.1.0"
