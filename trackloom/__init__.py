"""Trajectory and review-record analytics on Spark."""
