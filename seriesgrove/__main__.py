"""python -m seriesgrove --name=value ...: see config.Config."""

import sys

from seriesgrove.operators import lifecycle

if __name__ == "__main__":
    lifecycle.main(sys.argv[1:])
