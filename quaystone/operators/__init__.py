"""Operators over tables of objects, versions, replicas, rules and requests."""
