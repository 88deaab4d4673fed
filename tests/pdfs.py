"""The maker of PDF files, under a short name."""

from textloom.pdf.make import *  # noqa: F403
from textloom.pdf.make import Paper, Ref, value  # noqa: F401
