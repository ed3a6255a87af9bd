"""What has been done, by a hash of the settings, so that a changed run isn't taken for a finished one."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from ..sources.files import read_json, write_json


class Manifest:
    """Per setting and month some counts; months without hits are recorded too. One file, replaced whole."""

    def __init__(self, root, **settings: object):
        self.path = Path(root, "manifest.json")
        self.key = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]
        self.settings = settings
        self.data = read_json(self.path) or {}

    @property
    def months(self) -> dict[str, dict]:
        return self.data.setdefault(self.key, {"settings": json.loads(json.dumps(self.settings, default=str)), "months": {}})["months"]

    def pending(self, months: list[str], force: bool = False) -> list[str]:
        return [m for m in months if force or m not in self.months]

    def done(self, counts: dict[str, dict]) -> None:
        self.months.update(counts)
        write_json(self.path, self.data)
