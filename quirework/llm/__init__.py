"""Operators for building training data, each as DataFrame -> DataFrame."""
