import sys

from breathline.cli import main

sys.exit(main())
