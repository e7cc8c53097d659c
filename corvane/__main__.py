import sys

from corvane.cli import main

sys.exit(main())
