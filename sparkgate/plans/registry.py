"""All queries of the reference's operators, and their SQL."""

from sparkgate.plans import catalogue, exports, further, records, scalar, scans, tabled, tracing

QUERIES = catalogue.QUERIES | further.QUERIES | records.QUERIES | tabled.QUERIES | exports.QUERIES | scans.QUERIES | scalar.QUERIES | tracing.QUERIES
SQL = catalogue.SQL | further.SQL | records.SQL | tabled.SQL | exports.SQL | scans.SQL | scalar.SQL | tracing.SQL | {"x01_stream_admission": catalogue.SQL["j06_budget_admission"]}
