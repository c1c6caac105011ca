import sys

from termweave.cli import main

sys.exit(main())
