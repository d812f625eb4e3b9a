import sys

from veltra.cli import main

sys.exit(main())
