"""Command line: python -m textloom."""

from .plans.job import main

main()
