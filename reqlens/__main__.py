import sys

from reqlens.cli import main

main(sys.argv[1:])
