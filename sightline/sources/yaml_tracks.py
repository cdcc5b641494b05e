"""Ground-truth track files in block-style YAML, a frame at a time.

A file is a map with `metadata` and, last, `frames`, a list of maps with
frame_time and objects (by id: box, class, conf). Frames are found by the marks of the list, at
the indentation of its first item, so a range of a file needs nothing of the
ranges before it. Values are numbers or plain or quoted text; boxes are flow
lists or block lists. Anchors, tags and multi-line text are not read.
"""

from __future__ import annotations

import re

from sightline.sources import ranged


def scalar(text: str):
    text = text.strip()
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("["):
        return [scalar(x) for x in text.strip("[]").split(",") if x.strip()]
    if text in ("{}", "", "~", "null"):
        return {} if text == "{}" else None
    try:
        return int(text)
    except ValueError:
        pass
    try:
        return float(text)
    except ValueError:
        return text


def block(lines: list[tuple[int, str]]):
    """The value of lines (indentation, text): a list if they begin with a mark, else a map."""
    if not lines:
        return None
    depth = lines[0][0]
    heads = [i for i, (n, x) in enumerate(lines) if n == depth and (x.startswith("- ") or x == "-") == lines[0][1].startswith("-")]
    out: list | dict = [] if lines[0][1].startswith("-") else {}
    for a, b in zip(heads, [*heads[1:], len(lines)], strict=True):
        text, inner = lines[a][1], lines[a + 1 : b]
        if isinstance(out, list):
            rest = text[1:].lstrip()
            out.append(block(inner) if not rest else block([(depth + len(text) - len(rest), rest), *inner]) if re.match(r"[^\[{'\"]*:( |$)", rest) else scalar(rest))
        else:
            key, _, value = text.partition(":") if text[:1] not in "'\"" else (text[: text.index(text[0], 1) + 1], ":", text[text.index(text[0], 1) + 1 :].lstrip().removeprefix(":"))
            out[str(scalar(key))] = scalar(value) if value.strip() else block(inner)
    return out


def lines_of(text: str) -> list[tuple[int, str]]:
    return [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]


class YamlTracks(ranged.RangedSource):
    suffix, columns = ".yaml", "offset long, frame binary"

    @classmethod
    def name(cls) -> str:
        return "sightline_yaml_tracks"

    def _list(self, file) -> tuple[bytes, int] | None:
        """The mark of the list's items and where the first begins."""
        head = file.find(b"frames:", 0, file.size) if file.at(0, 7) == b"frames:" else file.find(b"\nframes:", 0, file.size) + 1
        first = file.find(b"-", head, file.size)
        if not first > 0:
            return None
        indent = 0
        while file.at(first - indent - 1, 1) == b" ":
            indent += 1
        return b"\n" + b" " * indent + b"-", first - indent - 1

    def rows(self, file, part):
        # the ranges of a task look for it once a file
        if not hasattr(file, "list"):
            file.list = self._list(file)
        if file.list is None:
            return
        mark, begin = file.list
        at = file.find(mark, max(part.start, begin), part.end)
        while at >= 0:
            after = file.find(mark, at + len(mark), file.size)
            yield at + 1, file.at(at + 1, (after if after >= 0 else file.size) - at - 1)
            at = after if after < part.end else -1


#: An object and a frame in the common layout (two spaces a level, box, class, conf), which needs no general parser.
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_OBJECT = rf" *['\"]?(-?\d+)['\"]?:\n *box: \[({_NUMBER}), ({_NUMBER}), ({_NUMBER}), ({_NUMBER})\]\n *class: ([^\n'\"\[{{#:]+)\n *conf: ({_NUMBER})\n"
_PLAIN_OBJECT = re.compile(_OBJECT)
_PLAIN_FRAME = re.compile(rf"( *)- frame_time: ({_NUMBER})\n\1  objects:(?: \{{\}}\n?|\n((?:\1    (?P<q>['\"]?)-?\d+(?P=q):\n\1      box: \[{_NUMBER}(?:, {_NUMBER}){{3}}\]\n\1      class: [^\n'\"\[{{#:]+\n\1      conf: {_NUMBER}\n)+))\n*")


def parsed(text: bytes) -> tuple[float, list[dict]]:
    """Time and objects of a frame."""
    own = text.decode("utf-8", "replace")
    plain = _PLAIN_FRAME.fullmatch(own if own.endswith("\n") else own + "\n")
    if plain:
        found = _PLAIN_OBJECT.findall(plain[3] or "")
        # of objects of one id the last counts
        objects = {str(int(name)): {"gt_id": int(name), "cl": str(scalar(cl)), "conf": float(conf), "x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)} for name, x0, y0, x1, y1, cl, conf in found}
        return float(plain[2]), list(objects.values())
    return general(text)


def general(text: bytes) -> tuple[float, list[dict]]:
    """parsed() for any layout."""
    frame = block(lines_of(text.decode("utf-8", "replace")))[0]
    objects = []
    for name, o in (frame.get("objects") or {}).items():
        box = [float(x) for x in o["box"]]
        objects.append({"gt_id": int(name), "cl": str(o.get("class")), "conf": float(o.get("conf") if o.get("conf") is not None else 1.0), **dict(zip(("x0", "y0", "x1", "y1"), box, strict=True))})
    return float(frame["frame_time"]), objects
