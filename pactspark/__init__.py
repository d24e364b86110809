"""A policy-enforcing analytics engine on Spark: every table is a data contract."""
