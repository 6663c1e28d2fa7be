"""Where the repository lies."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
