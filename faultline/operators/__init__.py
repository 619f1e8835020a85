"""Operators: functions from DataFrames to DataFrames over the tidy model of ``faultline.schema``."""
