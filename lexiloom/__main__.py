import sys

from lexiloom.cli import main

sys.exit(main(sys.argv[1:]))
