"""postledger: job-posting provenance as Spark jobs.

Landed board files become deduplicated jobs with explained evidence; every
function takes DataFrames (or Columns) and returns DataFrames (or Columns).
"""
