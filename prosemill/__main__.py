"""Runs the command line."""

import sys

from prosemill.cli import main

sys.exit(main())
