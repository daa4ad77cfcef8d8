"""Meshwork: a graph and corpus analytics engine written on the public DataFrame and SQL API."""
