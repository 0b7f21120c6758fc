import sys

from tessera.cli import main

sys.exit(main())
