"""The registered queries; both modules register theirs in ``driver``."""

from . import driver as driver
from . import products as products
