"""Bipartite repertoire analytics on Spark: sets, groups, networks, nestedness, modules, null models."""
