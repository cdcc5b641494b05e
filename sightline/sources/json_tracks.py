"""Ground-truth track files in JSON, a frame at a time.

A frame is an object whose first key is "frame_time"; in text, quotes are
escaped, so the key with a brace before it and a colon after it is found in any
range of a file. A file whose frames begin with another key is refused; read it
whole (labels.read_trackset without range_bytes).
"""

from __future__ import annotations

import json
import re

from sightline.sources import ranged

KEY = b'"frame_time"'
_AFTER = re.compile(rb"\s*:")
#: White space around a mark that is looked through.
_NEAR = 256


class JsonTracks(ranged.RangedSource):
    suffix, columns = "", "offset long, frame binary"

    @classmethod
    def name(cls) -> str:
        return "sightline_json_tracks"

    def _mark(self, file, start: int, end: int) -> tuple[int, int]:
        """Where the next key is whose frame begins with it, and its frame; -1 if there is none."""
        at = file.find(KEY, start, end)
        while at >= 0:
            before = file.at(max(0, at - _NEAR), min(at, _NEAR)).rstrip()
            if _AFTER.match(file.at(at + len(KEY), _NEAR)):
                if not before.endswith(b"{"):
                    raise ValueError("a frame does not begin with its frame_time: read the file whole")
                return at, max(0, at - _NEAR) + len(before) - 1
            at = file.find(KEY, at + 1, end)
        return -1, -1

    def rows(self, file, part):
        at, begin = self._mark(file, part.start, part.end)
        while at >= 0:
            after, next_begin = self._mark(file, at + len(KEY), file.size)
            yield begin, file.at(begin, (next_begin if after >= 0 else file.size) - begin)
            at, begin = (after, next_begin) if after < part.end else (-1, -1)


def parsed(text: bytes) -> tuple[float | None, list[dict]]:
    """Time and objects of a frame; what follows it in the file may follow it here."""
    frame, _ = json.JSONDecoder().raw_decode(text.decode("utf-8", "replace"))
    objects = []
    for name, o in (frame.get("objects") or {}).items():
        o = o or {}
        box = [*(o.get("box") or ()), None, None, None, None]
        conf = o.get("conf")
        objects.append({"gt_id": int(name), "cl": o.get("class"), "conf": 1.0 if conf is None else float(conf), **{c: None if x is None else float(x) for c, x in zip(("x0", "y0", "x1", "y1"), box, strict=False)}})
    return frame.get("frame_time"), objects
