import sys

from ordertide.cli import main

sys.exit(main())
