"""Registries of estimators, losses, rewards, parsers and sources, by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    """Names to things of one kind. A name may be given again only to the same thing; names are case-sensitive."""

    def __init__(self, kind: str):
        self.kind, self.found = kind, {}

    def register(self, name: str) -> Callable[[Any], Any]:
        def add(thing: Any) -> Any:
            if self.found.setdefault(name, thing) is not thing:
                raise ValueError(f"{self.kind} {name} is taken")
            return thing

        return add

    def get(self, name: str) -> Any:
        if name not in self.found:
            raise ValueError(f"no {self.kind} {name}; there are {sorted(self.found)}")
        return self.found[name]


advantages, policy_losses, rewards, tool_parsers, sources, partitioners = map(Registry, ("advantage", "policy loss", "reward", "tool parser", "source", "partitioner"))


def load_function(path: str, name: str, **bound: Any) -> Callable:
    """A function from a file, with keyword arguments bound."""
    import importlib.util
    from functools import partial

    spec = importlib.util.spec_from_file_location("sievework_custom", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return partial(getattr(module, name), **bound)
