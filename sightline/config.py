"""Settings: nested configuration with platform conditions, and detector settings."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


def merged(base: Any, over: Any) -> Any:
    """over on base: maps merge key by key, anything else is replaced."""
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: merged(base[k], over[k]) if k in base and k in over else over.get(k, base.get(k)) for k in [*base, *(k for k in over if k not in base)]}
    return over


def for_platform(tree: Any, platform: str, platforms: tuple[str, ...] = ("nvidia", "jetson", "cpu")) -> Any:
    """The tree for one platform: keys of the form name@platform hold for that one only and take the plain name."""
    if isinstance(tree, list):
        return [for_platform(x, platform, platforms) for x in tree]
    if not isinstance(tree, dict):
        return tree
    out: dict = {}
    for k, v in tree.items():
        name, _, where = str(k).partition("@")
        if where and where in platforms:
            if where == platform:
                out[name] = merged(out.get(name), for_platform(v, platform, platforms)) if name in out else for_platform(v, platform, platforms)
        elif k not in out:
            out[k] = for_platform(v, platform, platforms)
    return out


def get(tree: dict, path: str, default: Any = None) -> Any:
    """The value at a dotted path, as the default's type; the default if there is none."""
    now: Any = tree
    for k in path.split("."):
        if not isinstance(now, dict) or k not in now:
            return default
        now = now[k]
    if default is None or isinstance(now, type(default)):
        return now
    if isinstance(default, bool):
        return str(now).lower() in ("1", "true", "yes", "on")
    return type(default)(now)


@dataclass(frozen=True)
class InferConfig:
    """Detector settings; None keeps what is set."""

    det_thr: float | None = None
    nms_thr: float | None = None
    limit_max_batch: int | None = None
    limit_max_width: int | None = None
    limit_max_height: int | None = None
    limit_min_width: int | None = None
    limit_min_height: int | None = None
    max_detections: int | None = None
    use_cuda_nms: bool | None = None
    fuse_face_person: bool | None = None
    class_filter: int | None = None

    @classmethod
    def of(cls, values: dict) -> InferConfig:
        """From a map; unknown names are an error."""
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise KeyError(f"unknown settings: {sorted(unknown)}")
        return cls(**values)

    def over(self, other: InferConfig) -> InferConfig:
        """other with this one's set fields."""
        return replace(other, **{f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None})


@dataclass(frozen=True)
class ModelDescription:
    """Class and attribute names of a detector, from its configured names: those that start with person_ are attributes, and numbers in person_fiqa_ names are weights."""

    names: tuple[str, ...]
    key_points: int = 0
    reid: int = 0

    @property
    def classes(self) -> list[str]:
        return [n for n in self.names if not n.startswith("person_")]

    @property
    def attributes(self) -> list[str]:
        return [n for n in self.names if n.startswith("person_")]

    @property
    def fiqa_weights(self) -> dict[int, float]:
        import re

        return {i: float(m[1]) + 0.1 for i, n in enumerate(self.attributes) if n.startswith("person_fiqa_") and (m := re.search(r"([0-9.]+)$", n))}

    def index(self, name: str) -> int | None:
        return self.classes.index(name) if name in self.classes else None
