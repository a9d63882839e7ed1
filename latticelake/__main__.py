"""``python -m latticelake``."""

import sys

from latticelake.cli import main

sys.exit(main())
