"""Scalar column functions (Column -> Column), all native Spark expressions."""

from stayspark.functions.text import PY_WS, col_or_lit, py_split, py_strip, py_title  # noqa: F401
from stayspark.functions.dates import *  # noqa: F401,F403
from stayspark.functions.bookings import *  # noqa: F401,F403
from stayspark.functions.planner import *  # noqa: F401,F403
from stayspark.functions.listing import *  # noqa: F401,F403
from stayspark.functions.labels import *  # noqa: F401,F403
