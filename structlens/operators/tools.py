"""The operators by name, with what they take: for callers that choose one at run time."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import edit, export, extract, graph, impact, incremental, outline, read, relate, summary, symbols, tokens

#: Modules by what calling them does to stored data: most return plans and change nothing.
_READS = (outline, symbols, tokens, extract, read, relate, graph, impact, summary, incremental, edit)
_WRITES = (export,)
_KINDS: dict[str, tuple[type, ...]] = {"int": (int,), "str": (str,), "bool": (bool,), "float": (int, float), "DataFrame": (DataFrame,), "SparkSession": (SparkSession,)}
_JSON = {"int": "integer", "str": "string", "bool": "boolean", "float": "number"}


def _tools() -> dict[str, tuple[Callable, bool]]:
    out = {}
    for module in (*_READS, *_WRITES):
        for name, f in vars(module).items():
            if inspect.isfunction(f) and not name.startswith("_") and f.__module__ == module.__name__:
                out[f"{module.__name__.rsplit('.', 1)[1]}.{name}"] = (f, module in _READS)
    return out


def _parts(annotation: str) -> list[str]:
    return [p.strip() for p in str(annotation).split("|")]


def schema(name: str) -> dict[str, Any]:
    """What an operator takes, as a JSON schema; tables are named by ``x-table``."""
    f, _ = _tools()[name]
    properties, required = {}, []
    for p in inspect.signature(f).parameters.values():
        kinds = [k for k in _parts(p.annotation) if k != "None"]
        own = {"x-table": True} if "DataFrame" in kinds else {"type": _JSON[kinds[0]]} if kinds and kinds[0] in _JSON else {}
        properties[p.name] = own
        if p.default is inspect.Parameter.empty and p.kind not in (p.VAR_KEYWORD, p.VAR_POSITIONAL):
            required.append(p.name)
    return {"type": "object", "properties": properties, "required": required}


def tools() -> list[dict[str, Any]]:
    """name, description, input_schema, read_only and idempotent of every operator."""
    return [{"name": name, "description": (inspect.getdoc(f) or "").split("\n")[0], "input_schema": schema(name), "read_only": reads, "idempotent": True} for name, (f, reads) in sorted(_tools().items())]


def call(name: str, **arguments: Any) -> Any:
    """Call an operator after its arguments were checked: all that it needs, none that it doesn't know, and of the kinds that it says."""
    known = _tools()
    if name not in known:
        raise ValueError(f"unknown operator: {name}")
    f, _ = known[name]
    parameters = inspect.signature(f).parameters
    if missing := [p for p in schema(name)["required"] if p not in arguments]:
        raise ValueError(f"{name}: missing {', '.join(missing)}")
    if extra := [a for a in arguments if a not in parameters]:
        raise ValueError(f"{name}: unknown {', '.join(extra)}")
    for key, value in arguments.items():
        kinds = _parts(parameters[key].annotation)
        allowed = tuple(t for k in kinds for t in _KINDS.get(k, ()))
        wrong = allowed and all(k in _KINDS or k == "None" for k in kinds) and not (value is None and "None" in kinds) and (not isinstance(value, allowed) or isinstance(value, bool) and bool not in allowed)
        if wrong:
            raise ValueError(f"{name}: {key} has to be {' or '.join(kinds)}")
        if key in ("limit", "cap", "depth", "most") and isinstance(value, int) and value < 0:
            raise ValueError(f"{name}: {key} can't be negative")
    return f(**arguments)
