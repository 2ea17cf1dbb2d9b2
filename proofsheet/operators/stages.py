"""A registry of stages, so that a cascade can be named and extended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .identify import waterfall

#: A stage takes the open probes and returns probe_id, matched_id, confidence of those it decides.
Stage = Callable[[DataFrame], DataFrame]
_factories: dict[str, Callable[..., Stage]] = {}


def register(name: str) -> Callable:
    """Register a factory of stages; a name can be taken once."""

    def put(factory: Callable[..., Stage]) -> Callable[..., Stage]:
        if name in _factories:
            raise ValueError(f"stage {name} is registered already")
        _factories[name] = factory
        return factory

    return put


def registered() -> list[str]:
    return list(_factories)


def build(name: str, *args, **options) -> Stage:
    if name not in _factories:
        raise KeyError(f"no stage {name}; there are {', '.join(_factories) or 'none'}")
    return _factories[name](*args, **options)


def cascade(probes: DataFrame, names: list[str], options: dict[str, dict] | None = None) -> DataFrame:
    """The registered stages in order; what none decides is refused."""
    return waterfall(probes, [(n, build(n, **(options or {}).get(n, {}))) for n in names])


@register("photograph_fallback")
def photograph_fallback() -> Stage:
    """A place for a stage that reads photographs; it decides nothing."""
    return lambda probes: probes.filter("false").selectExpr("probe_id", "cast(null as bigint) as matched_id", "0.0D as confidence")
