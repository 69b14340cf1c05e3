"""Learner-funnel analytics on Spark.

Raw app event logs are reduced to one row per learner, cleaned, filtered to a
cohort and aggregated into acquisition funnels.  Every job is a DataFrame plan
made of built-in functions.
"""

from readtrail.config import AppProfile

__all__ = ["AppProfile"]
