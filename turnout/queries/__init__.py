from turnout.queries.registry import QUERIES  # noqa: F401
from turnout.queries import analytics, audience, content, crm, identity, rows, streams  # noqa: F401
