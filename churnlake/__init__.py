"""churnlake: a Spark-native customer-churn analytics engine.

Raw snapshot -> staging -> mart -> quality audits -> splits / features /
learners / metrics -> whole-portfolio scoring -> prediction mart, snapshot
and lineage -> read queries. Every step is a DataFrame function that
Catalyst plans; nothing is collected to the driver except bounded scalars
(counts, a handful of quantile boundaries, model coefficients).
"""

__all__ = ["session", "schemas"]
