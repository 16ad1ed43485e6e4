"""Operators for preparing language-model training text, each on whole tables.

One module per operator; ``queries`` registers them. Nothing else in the package
imports this folder.
"""
