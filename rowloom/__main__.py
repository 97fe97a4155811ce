import sys

from rowloom.cli import main

sys.exit(main())
