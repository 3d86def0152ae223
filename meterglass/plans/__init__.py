from . import catalog, clients, views  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
