"""Queries on the test tables. Importing the package registers those of all its modules."""

from orbitframe.plans import catalogue  # noqa: F401, I001
from orbitframe.plans import archive  # noqa: F401
from orbitframe.plans import study  # noqa: F401
