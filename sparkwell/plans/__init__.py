"""The registered queries; importing the package registers all of them."""

from sparkwell.plans import queries  # noqa: I001
from sparkwell.plans import canonical, dashboard, deltas, excerpts, facade, memory, payloads, prices, search, sessions, symbols
