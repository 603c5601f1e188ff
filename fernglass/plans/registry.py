"""The queries over the driver's tables, and SQL for each that SQL can express."""

from fernglass.plans import images, names, records

QUERIES = {**images.QUERIES, **names.QUERIES, **records.QUERIES}
ORACLES = {**images.ORACLES, **names.ORACLES, **records.ORACLES}
