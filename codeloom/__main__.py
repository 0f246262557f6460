"""python -m codeloom {version, ingest, scan, graph build, graph cycles, serve}"""

import sys

from .cli import main

sys.exit(main())
