import sys

from sieveline.cli import main

sys.exit(main())
