"""Paragem: industrial-maintenance analytics as lazy Spark DataFrame plans.

Stops are de-bounced into failure groups, filtered, rolled up into MTBF / MTTR /
OPE indicators, and turned into breakdown-risk and remaining-useful-life models.
"""
