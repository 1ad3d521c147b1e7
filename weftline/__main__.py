"""python -m weftline [ROOT [STORE]]: the tool server."""

from weftline.plans.server import main

main()
