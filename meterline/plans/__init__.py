"""Query registries; importing this package fills them."""

from meterline.plans import capacity, lifecycle, pairing, registry, reviewing, statistics, timing, windows  # noqa: F401
