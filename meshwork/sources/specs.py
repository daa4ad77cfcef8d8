"""Names with parameters on the command line, and presets of data sets."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Shares of edges that are inserted and deleted, by preset.
PRESETS = {"updates": (0.1, 0.1), "static": (0.0, 0.0), "stream": (0.99, 0.0)}


@dataclass(frozen=True)
class Spec:
    name: str
    parameters: tuple[str, ...] = field(default=())


def parse(text: str) -> list[Spec]:
    """The specs of ``name``, ``name(p1'p2)``, and so on, with commas between them. Blanks around parts do not count."""
    out = []
    for part in (p.strip() for p in _split(text)):
        if not part:
            raise ValueError(f"an empty name in {text!r}")
        name, mark, rest = part.partition("(")
        name = name.strip()
        if not name or ")" in name or mark and (not rest.endswith(")") or rest.count(")") != 1 or "(" in rest):
            raise ValueError(f"not a name with parameters: {part!r}")
        inside = rest[:-1].strip()
        out.append(Spec(name, tuple(p.strip() for p in inside.split("'")) if inside else ()))
    return out


def _split(text: str) -> list[str]:
    parts, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def preset(name: str) -> tuple[float, float]:
    """(insert share, delete share) of a preset."""
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}: {', '.join(PRESETS)}")
    return PRESETS[name]
